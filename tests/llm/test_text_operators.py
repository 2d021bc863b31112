"""Text operators against plain Python on odd and on given rows."""

from __future__ import annotations

import re
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from splitlane.llm import common, oracle
from splitlane.llm import words as W
from splitlane.llm.decontaminate import contamination, decontaminated, hit_words
from splitlane.llm.hilbert import hilbert_index, hilbert_shards, shard_ranges, spread, write_shards
from splitlane.llm.licenses import differences, license_scan
from splitlane.llm.near_dup import deduplicated, near_duplicates
from splitlane.llm.packing import pack, packed
from splitlane.llm.pii import Crf, labelled_table, personal_data, redacted, train, train_from
from splitlane.llm.pii_base import base_spans, emails
from splitlane.llm.queries import QUERIES
from splitlane.llm.repetition import judged, repetition
from splitlane.llm.suffixes import common_prefixes, suffix_array
from splitlane.llm.weak_labels import quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def test_words_are_split_within_texts_and_hashed_by_content():
    texts = ["The cat  sat\ton é A", "", None, "cat", "cat", " x ", "ab", "c"]
    raw, offsets = W.utf8(pa.array(texts))
    found = W.split(raw, offsets, W.NOT_SPACE)
    assert found.count.tolist() == [len(words(t)) for t in texts]
    assert found.hash[1] == found.hash[6] == found.hash[7] != found.hash[0]


def test_suffix_array_and_prefixes_equal_sorting():
    rng = np.random.default_rng(1)
    for n, top in ((0, 3), (1, 3), (60, 2), (300, 5), (200, 1)):
        t = rng.integers(0, top, n)
        order, ranks = suffix_array(t, n + 1)
        wanted = sorted(range(n), key=lambda i: t[i:].tolist())
        assert order.tolist() == wanted
        shared = [0] * n
        for k in range(1, n):
            a, b = t[wanted[k - 1] :].tolist(), t[wanted[k] :].tolist()
            while shared[k] < min(len(a), len(b)) and a[shared[k]] == b[shared[k]]:
                shared[k] += 1
        assert common_prefixes(order, ranks).tolist() == shared


def test_near_duplicates_equal_all_pairs(spark, odd_docs, no_docs):
    got = near_duplicates(odd_docs, width=2).collect()
    assert len(got) == odd_docs.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id is not None}
    sets = {}
    for i, t in texts.items():
        w = words((t or "").lower())
        sets[i] = {tuple(w)} - {()} if len(w) < 2 else set(zip(w, w[1:], strict=False))
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    for i, s in sets.items():
        assert (by_id[i].n_shingles, by_id[i].component_id, by_id[i].kept) == (len(s), root[i], root[i] == i)
    nameless = [r for r in got if r.doc_id is None]
    assert [(r.component_id, r.kept) for r in nameless] == [(None, True)]
    assert near_duplicates(no_docs).count() == 0


def test_long_lists_and_tiles_find_every_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(4000)]
    base = [vocabulary[k] for k in rng.integers(0, 4000, 120)]
    rows = []
    for i in range(90):
        own = list(base)
        for k in rng.choice(120, rng.integers(0, 16), replace=False):
            own[k] = vocabulary[rng.integers(0, 4000)]
        rows.append((i * 7 + 5, " ".join(own)))
    from splitlane.llm import near_dup

    monkeypatch.setattr(near_dup, "TILE", 16)
    sets = {i: set(zip(t.split(), t.split()[1:], strict=False)) for i, t in rows}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[a] > root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a], changed = root[b], True
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2)
    assert {r.doc_id: r.component_id for r in got.collect()} == root


def test_deduplicated_keeps_one_of_each_group(odd_docs, no_docs):
    kept = deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids)[5] == 1 and not {6, 7, 8, 99} & set(ids) and None in ids
    assert {0, 1, 2, 3, 4, 9, 10} <= set(ids)
    assert deduplicated(no_docs).count() == 0


@pytest.mark.parametrize("name", ["op4_suffix_decontamination", "op8_minhash_near_dup"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = QUERIES[name].run(spark, SF)
    cursor = con.execute(QUERIES[name].sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(map(tuple, frame.select(columns).collect())) == sorted(cursor.fetchall())
    assert oracle.NEAR_DUP


def test_contamination_of_odd_texts_and_test_blocks(spark, odd_docs, no_docs, monkeypatch):
    long_text = odd_docs.where("doc_id = 9").first().text.split(" ")
    items = spark.createDataFrame(
        [(1, "One  TWO"), (2, " ".join(long_text[500:512])), (2, " ".join(long_text[700:711])), (3, None), (4, ""), (None, "no id here")],
        "item_id long, text string",
    )
    once = contamination(odd_docs, items).select("row.doc_id", "out.*", hit_words().alias("hit"))
    found = {r.doc_id: r for r in once.collect()}
    assert found[4].items == ["1"] and found[4].hit == 2 and found[3].hit == 0
    assert found[9].hit == 23 and found[9].items == ["2"]
    assert {(m["doc_start"], m["length"]) for m in found[9].matches} == {(500, 12), (700, 11)}
    assert found[None].items == [""] and found[0].n_words == 0
    assert decontaminated(odd_docs, items).columns == odd_docs.columns
    assert decontaminated(odd_docs, items).count() == odd_docs.count() - 3
    assert decontaminated(no_docs, items).count() == 0
    assert decontaminated(odd_docs, items.where("false")).count() == odd_docs.count()
    from splitlane.llm import decontaminate

    monkeypatch.setattr(decontaminate, "TEST_BYTES", 40)
    blocked = contamination(odd_docs, items).select("row.doc_id", "out.items", hit_words().alias("hit"))
    want = {(r.doc_id, tuple(r["items"]), r.hit) for r in once.collect()}
    assert {(r.doc_id, tuple(r["items"]), r.hit) for r in blocked.collect()} == want


def test_contamination_holds_one_test_block_at_a_time(spark, odd_docs, monkeypatch):
    import gc
    import weakref

    from splitlane.llm import decontaminate

    long_text = odd_docs.where("doc_id = 9").first().text.split(" ")
    items = spark.createDataFrame([(k, " ".join(long_text[40 * k : 40 * k + 30])) for k in range(12)], "item_id long, text string")
    once = {(r.doc_id, r.out) for r in contamination(odd_docs, items).select("row.doc_id", "out.spans").select("doc_id", F.to_json(F.struct("spans")).alias("out")).collect()}
    alive, most, plain = [], [], decontaminate.TestItems

    def made(*args):
        gc.collect()
        most.append(sum(r() is not None for r in alive))
        block = plain(*args)
        alive.append(weakref.ref(block))
        return block

    monkeypatch.setattr(decontaminate, "TestItems", made)
    monkeypatch.setattr(decontaminate, "TEST_BYTES", 400)
    found = contamination(odd_docs, items)
    assert len(most) > 3 and max(most) <= 1  # the one before, until its place is taken
    assert {(r.doc_id, r.out) for r in found.select("row.doc_id", F.to_json(F.struct("out.spans")).alias("out")).collect()} == once
    assert found.count() == odd_docs.count()


def test_repetition_equals_window_counts(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text").unionByName(common.table(spark, SF, "documents").select("doc_id", "text"))
    for r in judged(repetition(docs)).select("row.text", "out.*", "base_failed", "kept").collect():
        w = words(r.text)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert r.n_symbols == sum((r.text or "").count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.kept and r.base_failed)
        assert {j for s in r.repeats for j in range(s["start"], s["start"] + s["length"])} == covered
    assert judged(repetition(no_docs)).count() == 0


def test_packing_places_every_id_once(odd_docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    rows = packed(odd_docs).collect()
    ids = {r.doc_id: np.array(encode(r.text or "", add_special_tokens=False).ids + [0], "<u4") for r in odd_docs.collect()}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(part), zlib.crc32(part.tobytes()), len(ids[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
    assert sum(r.length for r in rows) == sum(len(ids[r.doc_id]) for r in odd_docs.collect())
    used: dict[int, list] = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [a for a, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(used) == -(-sum(r.length for r in rows) // 1024)
    assert packed(no_docs).count() == 0


def test_costs_are_balanced():
    lengths = np.random.default_rng(0).integers(1, 200, 2000)
    load: dict[int, float] = {}
    for _, _, n, k, _ in pack(lengths, 1024, 1.0, 1 / 1024):
        load[k] = load.get(k, 0) + n + n * n / 1024
    costs = np.array(list(load.values()))
    assert costs.std() / costs.mean() < 0.05


def test_base_spans_follow_the_leftmost_rule():
    forms = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    cases = ["a@b.c_d@e.f", "@x.y a@@b.c", "a@b@c.d", "1.2.3.4.5.6.7.8", "1.2.3.999 0001.2.3.4", "+1 (2) 3-4 5678 9", "+1 2", "a.b@c-d.e.f."]
    for text in cases:
        assert emails(text) == [m.span() for m in re.finditer(forms["email"], text)]
        got = base_spans(text)
        want = [("ip", *m.span()) for m in re.finditer(forms["ip"], text) if all(int(x) < 256 for x in m[0].split("."))]
        want += [("phone", *m.span()) for m in re.finditer(forms["phone"], text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
        assert [s for s in got if s[0] in ("ip", "phone")] == want
    assert base_spans("4111-1111 1111 1111") == [("card", 0, 19)] and base_spans("4111 1111 1111 1112") == []
    assert base_spans("9" * 100_000) == []


def test_field_decodes_like_all_paths_and_learns_loose_forms():
    rng = np.random.default_rng(2)
    crf = Crf()
    crf.weights = [rng.normal(size=w.shape) for w in crf.weights]
    crf.pairs = rng.normal(size=crf.pairs.shape)
    index = [rng.integers(0, len(w), 4) for w in crf.weights]
    emit = crf.scores(index)
    from itertools import product

    best = max(product(range(9), repeat=4), key=lambda p: sum(emit[t, p[t]] for t in range(4)) + sum(crf.pairs[p[t], p[t + 1]] for t in range(3)))
    assert crf.decode(index, np.array([True, False, False, False])).tolist() == list(best)
    text = "call +1 (555) 010-%04d today or the next day please"
    found = train([(text % k, [("phone", 5, 22)]) for k in range(1000, 1040)] + [("nothing to see in 2024 here", [])] * 40)
    raw, offsets = W.utf8(pa.array(["ring +1 (555) 010-7777 today"]))
    from splitlane.llm.pii import added_spans

    assert [s[1:] for s in added_spans(raw, W.split(raw, offsets, W.NOT_SPACE), found)] == [("phone", 5, 22)]


def test_personal_data_of_odd_texts(odd_docs, no_docs):
    crf = train_from(labelled_table(odd_docs))
    rows = personal_data(odd_docs, crf=crf).select("row.*", "out.spans").collect()
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == base_spans(r.text or "")
    clean = redacted(odd_docs, crf)
    assert clean.columns == odd_docs.columns
    by_id = {r.doc_id: r for r in clean.collect()}
    assert by_id[10].text.startswith("<EMAIL> and <IP> or <CARD>, <PHONE>") and by_id[10].n_chars == len(by_id[10].text)
    assert by_id[0].text is None and by_id[1].text == ""
    assert redacted(no_docs, train_from(labelled_table(no_docs))).count() == 0


def test_spelled_out_addresses_and_missed_parts_go(spark, tmp_path):
    import corpus_pipeline

    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    mails = ["jane.doe [at] corp.example.org", "bob [at] example.com", "JANE.DOE [AT] EXAMPLE.ORG", "j.roe (at) mail.example.net", "ab.cd77 [at] mail.example.org"]
    texts = [f"Please write to {m} for the details of it" for m in mails]
    texts += ["contact jürgen.müller34@mail7.example.com today", "mail: ab.cd@mail.example.com or look at it there. Then go."]
    made = spark.createDataFrame([(-k - 1, t, "en", "x", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.select(*made.columns).unionByName(made).write.parquet(f"{tmp_path}/documents.parquet")
    spans = {r.doc_id: r.spans for r in QUERIES["op5_crf_pii"].run(spark, str(tmp_path)).where("doc_id < 0").collect()}
    for k, m in enumerate(mails):
        assert spans[-k - 1] == f"email:16:{16 + len(m)}"
    assert spans[-6] == "email:8:17,email:17:41" and spans[-7] == "email:6:28"
    clean = corpus_pipeline.redact(spark, common.table(spark, str(tmp_path), "documents"), str(tmp_path)).where("doc_id < 0")
    got = {r.doc_id: r.text for r in clean.collect()}
    assert {got[-k - 1] for k in range(len(mails))} == {"Please write to <EMAIL> for the details of it"}
    assert got[-6] == "contact <EMAIL><EMAIL> today" and got[-7] == "mail: <EMAIL> or look at it there. Then go."


def test_quality_agrees_with_labels_and_odd_texts(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents")
    got = quality(docs).select("row.doc_id", "out.kept").join(common.table(spark, sf, "labels"), "doc_id")
    shares = {r.quality: r.share for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert shares[1] > 0.97 and shares[0] < 0.1
    odd = {r.doc_id: r for r in quality(odd_docs).select("row.doc_id", "out.*").collect()}
    assert not any(odd[k].kept or odd[k].score for k in (0, 1, 2))
    assert quality(no_docs).count() == 0


def test_staleness_does_not_grow_with_length_but_sees_far_repeats():
    from splitlane.llm.weak_labels import BAD, GOOD, LABELLERS, ratios, votes

    rng = np.random.default_rng(4)
    vocabulary = np.array([f"w{chr(97 + k % 26)}{k}" for k in range(30_000)])
    chance = 1 / (np.arange(30_000) + 20)
    clean = lambda n: " ".join(rng.choice(vocabulary, n, p=chance / chance.sum()))
    texts = [clean(2_000), clean(20_000), clean(200_000), " ".join([clean(3_000)] * 8), "ab cd ef gh ij " * 1000]
    raw, offsets = W.utf8(pa.array(texts))
    found = W.split(raw, offsets, W.NOT_SPACE)
    stale = [name for name, *_ in LABELLERS].index("stale")
    values = ratios(raw, offsets, found)
    assert votes(values, found.count)[:, stale].tolist() == [GOOD, GOOD, GOOD, BAD, BAD]
    assert abs(values[1, stale] - values[2, stale]) < 0.02


def test_licenses_of_odd_texts(odd_docs, no_docs):
    found = {r.doc_id: r for r in license_scan(odd_docs).select("row.doc_id", "row.text", "out.*").collect()}
    (hit,) = found[11].found
    assert found[11].text[hit["start"] : hit["end"]] == "Released under the MIT License."
    assert (hit["license"], hit["differences"], hit["confirmed"]) == ("MIT", 0, True)
    assert found[0].n_blocks == 0 and license_scan(no_docs).count() == 0
    assert differences("a b c d".split(), "x a b d y".split()) == 1
    assert differences("a b".split(), []) == 2


def confirmed(texts):
    from splitlane.llm.licenses import TEMPLATES, scanning

    found = scanning(TEMPLATES)()(pa.array(texts)).to_pylist()
    return [[(f["license"], t[f["start"] : f["end"]]) for f in r["found"] if f["confirmed"]] for t, r in zip(texts, found, strict=True)]


@pytest.mark.parametrize("mark", ["", "// ", "# ", " * ", "dnl "])
def test_wrapped_and_commented_notices_are_confirmed(mark):
    from splitlane.llm.licenses import TEMPLATES

    long = [(name, text) for name, text in TEMPLATES if len(text) > 120]
    assert {name for name, _ in long} == {"MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause"}
    for width in (40, 60, 78):
        texts = ["some words before\n\n" + textwrap.indent(textwrap.fill(t, width), mark) + "\n\nand after" for _, t in long]
        assert [[name for name, _ in found] for found in confirmed(texts)] == [[name] for name, _ in long]


@pytest.mark.parametrize("n", [0, 20, 300, 3000])
def test_a_license_inside_a_long_line_is_confirmed(n):
    rng = np.random.default_rng(n)
    prose = ["".join(rng.choice(list("abdeilnorst"), rng.integers(2, 9))) for _ in range(n)]
    text = " ".join([*prose[: n // 2], "Licensed under the MIT License.", *prose[n // 2 :]])
    assert confirmed([text]) == [[("MIT", "Licensed under the MIT License.")]]


def test_every_license_of_a_block_is_returned_with_its_place():
    parts = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "All rights reserved."]
    want = list(zip(["MIT", "Apache-2.0", "proprietary"], parts, strict=True))
    assert confirmed(["\n".join(parts), " ".join(parts), "\n\n".join(["ab cd", *parts])]) == [want] * 3
    assert confirmed([" ".join(parts[:1] * 3)]) == [want[:1] * 3]


def test_hilbert_curve_is_continuous_and_shards_are_even(odd_docs, no_docs):
    cube = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij")).reshape(3, -1)
    place = hilbert_index(cube, 3)
    assert sorted(place) == list(range(512))
    assert np.abs(np.diff(cube[:, np.argsort(place)], axis=1)).sum(0).max() == 1
    ties = [F.col("doc_id")]
    placed = hilbert_shards(odd_docs, ["lang", "source", "n_chars"], ties, shards=5)
    slots: dict[int, list[int]] = {}
    for r in placed.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert shard_ranges(placed, ["n_chars"]).count() == 5
    assert hilbert_shards(no_docs, ["lang", "n_chars"], ties).count() == 0


def test_shards_prune_on_every_dimension(spark):
    assert spread(np.arange(5), 4, 8).tolist() == [0, 63, 127, 191, 255] and spread(np.zeros(2, int), 0, 8).tolist() == [0, 0]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    placed = hilbert_shards(docs, ["lang", "source", "n_chars"], [F.col("doc_id")]).cache()
    assert placed.count() == docs.count() and placed.exceptAll(placed.distinct()).count() == 0
    rows = placed.collect()
    ranges = shard_ranges(placed, ["lang", "source", "n_chars"]).collect()

    def touched(name, low, high):
        return sum(r[f"min_{name}"] <= high and r[f"max_{name}"] >= low for r in ranges)

    share = {}
    for name in ("lang", "source"):
        values = {r[name] for r in rows}
        share[name] = sum(touched(name, v, v) for v in values) / len(values)
    cuts = np.quantile([r.n_chars for r in rows], np.linspace(0, 1, 9))
    share["n_chars"] = np.mean([touched("n_chars", a, b) for a, b in zip(cuts, cuts[1:], strict=False)])
    assert share["lang"] <= 20 and share["source"] <= 20 and share["n_chars"] <= 30, share


def test_written_shards_hold_every_row_and_column(spark):
    path = common.fresh_path(spark, "shards-test") + "/out"
    schema = "doc_id long, n_chars long, rank string, `__part` string, `__spot` string, `__before` string, row string, tie0 string, shard string"
    rows = [(1, 5, "a", "b", "c", "d", "e", "f", "g"), (1, 5, "a", "b", "c", "d", "e", "f", "g"), (None, 7, *"abcdefg"), (3, None, *"abcdefg")]
    docs = spark.createDataFrame(rows, schema)
    write_shards(hilbert_shards(docs, ["n_chars"], [F.col("doc_id")], shards=2), path)
    read = spark.read.parquet(path)
    assert sorted(map(str, read.select(*docs.columns[:-1]).collect())) == sorted(map(str, docs.drop("shard").collect()))
    assert sorted((r.shard, r.slot) for r in read.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_sharding_query_against_brute_force(spark):
    got = QUERIES["op3_hilbert_sharding"].run(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    keys = [(r.curve, r.text_crc32, r.doc_id) for r in ordered]
    assert keys == sorted(keys)
    sizes = [sum(r.shard == k for r in got) for k in range(40)]
    assert sum(sizes) == len(got) and max(sizes) - min(sizes) <= 1
    for k in range(40):
        assert [r.slot for r in ordered if r.shard == k] == list(range(sizes[k]))


def test_maximal_repeats_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("ab"), n)) for n in (0, 4, 5, 9, 14, 30, 41)]
    texts += ["a " * 12, " ".join(rng.choice(list("abcd"), 200)), "p q r s t u x p q r s t u y p q r s t z", None]
    # The same passage in two texts is no repeat in either.
    texts += ["one two three four five six seven", "one two three four five six seven"]

    def brute(text):
        w = words(text)
        out = []
        for length in range(5, len(w)):
            where: dict[tuple, list[int]] = {}
            for i in range(len(w) - length + 1):
                where.setdefault(tuple(w[i : i + length]), []).append(i)
            for at in where.values():
                left = {w[i - 1] if i else None for i in at}
                right = {w[i + length] if i + length < len(w) else None for i in at}
                if len(at) > 1 and len(left) > 1 and len(right) > 1:
                    out.append((at[0], length, len(at)))
        return sorted(out)

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in repetition(docs).select("row.text", "out.maximal").collect():
        assert [tuple(m) for m in r.maximal] == brute(r.text)


def test_one_long_repeat_fails_a_text_that_the_base_rule_passes(spark):
    once = " ".join(f"w{i}" for i in range(2_000))
    docs = [(n, once + " " + " ".join(f"w{i}" for i in range(500, 500 + n))) for n in (100, 101)]
    rows = judged(repetition(spark.createDataFrame(docs, "doc_id long, text string"))).select("row.doc_id", "base_failed", "kept")
    assert sorted(map(tuple, rows.collect())) == [(100, False, True), (101, False, False)]
