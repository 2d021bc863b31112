"""Readers, the event contract and sinks."""

from splitlane.sources.activity_log import events_from_activity_log
from splitlane.sources.contract import EVENT_NAMES, EventTables
from splitlane.sources.lake import read_events, register_views

__all__ = [
    "EVENT_NAMES",
    "EventTables",
    "events_from_activity_log",
    "read_events",
    "register_views",
]
