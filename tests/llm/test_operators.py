"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitrail.llm import bpe, dedup, gam, license, license_data, overlap, packing, rules, shard, simhash, tokens, warc

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rnd, n):
    return " ".join(rnd.choice(["the", "of", "Ärger", "naïve,", "tower", "ÉCOLE", "blue", "猫", "x1", "it's", "sun."]) for _ in range(n))


def corpus():
    rnd = random.Random(7)
    texts = [None, "", " \t\n", "one", "one two", "a  b\n\nc\r\n", "don't <|endoftext|> stop", "é́ \x1c \x85  ", "\n".join(["same line here"] * 6)]
    texts += [prose(rnd, rnd.randint(3, 120)) for _ in range(40)]
    base = prose(rnd, 200)
    texts += [base, base, base.replace(" ", "  "), base + " ", base.upper()]
    words = base.split()
    for k in range(6):
        words = [*words]
        words[10 * k] = "changed"
        texts.append(" ".join(words))
    texts.append(prose(rnd, 6000))
    rows = [(k, t, "xx", "s", 1) for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[50], (None, "one", "xx", "s", 1), (None, None, "xx", "s", 1)]


SCHEMA = "doc_id bigint, text string, word string, bits string, shard int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def slow_spans(text, tokens):
    """Character spans of tokens, by counting characters byte by byte."""
    owner = [k for k, c in enumerate(text) for _ in c.encode()]
    out, at = [], 0
    for raw in tokens:
        out.append((owner[at], owner[at + len(raw) - 1] + 1))
        at += len(raw)
    return out


def test_bpe_matches_the_rank_encoder(docs, none):
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    want = Counter()
    for i, t, *_ in corpus():
        raw = np.array(encoder.encode_ordinary(t or ""), "<u4").tobytes()
        spans = np.array(slow_spans(t or "", [encoder.decode_single_token_bytes(k) for k in np.frombuffer(raw, "<u4").tolist()]), "<u4").tobytes()
        want[(i, len(raw) // 4, *(hashlib.sha256(x).hexdigest() for x in (raw, (t or "").encode(), spans)))] += 1
    assert Counter(tuple(r) for r in bpe.digests(docs, MULTI, public_tokenizers.PATTERN).collect()) == want
    assert bpe.digests(none, MULTI, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_odd_strings_and_split_characters():
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    own, rnd = bpe.codec(MULTI, public_tokenizers.PATTERN), random.Random(3)
    bits = [*" \n\tab'sTé猫😀́ \x85\x1c1²ǅ…,!​ ", "   ", "\r\n", "don't", "क्"]
    for _ in range(1500):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))
        ids = np.frombuffer(own.encode(text), "<u4")
        assert ids.tolist() == encoder.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
        assert "".join(bpe.decode_stream(own.table[i] for i in ids)) == text
        first, last = bpe.char_bounds(text.encode(), own.byte_ends(ids))
        assert all(text[a:b].encode().find(own.table[i]) >= 0 for a, b, i in zip(first, last, ids))


def test_bpe_offsets_and_decode_as_columns(docs):
    made = bpe.decode(bpe.encode(docs.select("doc_id", "text"), BYTES, None, offsets="spans"), BYTES, None)
    for row in made.collect():
        assert bytes(row.decoded).decode() == (row.text or "")
        assert len(row.spans) == len(row.ids) // 4
        if row.spans:
            assert (row.spans[0].first, row.spans[-1].last) == (0, len(row.text))


def test_bpe_refuses_taken_names_and_gives_unknown_vocabularies_whole_texts(docs):
    with pytest.raises(ValueError):
        bpe.decode(bpe.encode(docs.select("doc_id", "text"), BYTES, None, ids="Decoded"), BYTES, None, ids="Decoded")
    assert bpe.codec(MULTI, public_tokenizers.PATTERN).in_pieces and bpe.codec(BYTES, None).in_pieces
    words = r"\w+ \w+|\S+|\s+"  # crosses blanks
    own, encoder = bpe.codec(MULTI, words), tiktoken.Encoding("own", pat_str=words, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    assert not own.in_pieces
    for _, t, *_ in corpus()[:40]:
        assert np.frombuffer(own.encode(t or ""), "<u4").tolist() == encoder.encode_ordinary(t or "")


def best_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                n, at = n + 1, 0
            at += s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards(docs, shards):
    rows = shard.assign(docs, shards).collect()
    assert len(rows) == len(corpus())
    groups, spread = Counter(), defaultdict(set)
    texts = {r[0]: r[1] or "" for r in corpus() if r[0] is not None}
    for r in rows:
        if r.doc_id is not None:
            raw = texts[r.doc_id].encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
            spread[raw].add(r.shard)
    for i, t, *_ in corpus():
        groups[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 8
    assert all(len(s) == 1 for s in spread.values())
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    own, left, alone = sorted(groups, key=lambda k: (-groups[k], k)), sum(groups.values()), []
    while len(alone) < shards - 1 and groups[own[len(alone)]] * (shards - len(alone)) >= left:
        left -= groups[own[len(alone)]]
        alone.append(own[len(alone)])
    others = [groups[k] for k in sorted(groups) if k not in alone]
    assert max(load.values()) == max([best_capacity(others, shards - len(alone)), *(groups[k] for k in alone)])
    for s in load:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shards_of_nothing_and_of_one_hot_group(spark, none):
    assert shard.assign(none).count() == 0
    hot = spark.createDataFrame([(k, "same" * 50 if k % 3 == 0 else f"text {k} " * (1 + k % 9)) for k in range(600)], "doc_id bigint, text string")
    load = {r.shard: (r["n"], r["b"]) for r in shard.assign(hot, 8).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    assert len(load) == 8 and sum(n for n, _ in load.values()) == 600
    rest = sorted(b for _, b in load.values())[:-1]
    assert rest[-1] < 2 * rest[0] + 2000


def test_blocks_search_is_exact():
    rnd = random.Random(5)
    for _ in range(40):
        sizes = [rnd.randint(1, 50) for _ in range(rnd.randint(1, 60))]
        blocks = shard.Blocks([(f"{k:04x}", f"{k:04x}", s, 4) for k, s in enumerate(sizes)])
        n = rnd.randint(1, 9)
        found = blocks.smallest(n, max(max(sizes), -(-sum(sizes) // n)), False)
        assert found == best_capacity(sizes, n)
        cuts = [*blocks.cuts(n, found), "h"]
        parts = [sum(s for k, s in enumerate(sizes) if a <= f"{k:04x}" < b) for a, b in zip(["", *cuts], cuts)]
        assert sum(parts) == sum(sizes) and max(parts) <= found


def fill(name, width=72, start=""):
    import textwrap

    return textwrap.fill(license_data.TEXTS[name], width, initial_indent=start, subsequent_indent=start, break_on_hyphens=False)


def licensed(spark, texts):
    rows = list(enumerate(texts))
    return [r.licenses for r in sorted(license.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), key=lambda r: r.doc_id)]


def test_license_scan(spark, none):
    rows = [
        (1, "Intro. Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.\nMore."),
        (2, license_data.TEXTS["mit-grant"] + " words\n" + license_data.TEXTS["mit-notice"] + ".\n"),
        (3, license_data.TEXTS["mit-grant"] + "\nother\n" + license_data.TEXTS["mit-notice"] + ".\nAll rights reserved!"),
        (4, None), (5, ""), (6, "licensed UNDER cc by-nc  4.0. Licensed under CC BY-NC 4.0"), (7, "All rights reserved."), (7, "All rights reserved."),
    ]
    got = {r.doc_id: (r.n_known, r.sentence_ids, r.licenses) for r in license.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == (2, "apache-2.0-reference;mit-reference", "MIT;Apache-2.0")
    assert got[2][1:] == ("mit-grant;mit-notice", "MIT")
    assert got[3] == (3, "mit-grant;mit-notice;reserved", "MIT")
    assert got[4] == got[5] == (0, "", "")
    assert got[6] == (2, "cc-by-nc-4;cc-by-nc-4", "CC-BY-NC-4.0")
    assert got[7] == (1, "reserved", "proprietary")
    assert license.report(none).count() == 0


def test_license_scan_keeps_rows_and_clashing_columns(spark, docs):
    own = docs.withColumn("lines", F.lit(1)).withColumn("found", F.lit(2)).withColumn("left", F.lit(3))
    made = license.scan(own)
    assert made.columns == [*own.columns, "sentence_ids", "licenses"]
    assert Counter(r.doc_id for r in made.collect()) == Counter(r[0] for r in corpus())
    long = "word " * 200_000 + ".\nLicensed under the MIT License.\n" + "\n" * 5000 + "x" * 100_000
    assert licensed(spark, [long]) == ["MIT"]


def test_license_scan_of_wrapped_texts(spark):
    mit = "Copyright (c) 2020 Some One\n\n" + fill("mit-grant", 78) + "\n\n" + fill("mit-notice", 78) + ".\n"
    whole = mit + "\n" + fill("mit-warranty") + ". " + fill("mit-liability") + ".\n"
    apache = '# Copyright 2020 Some One\n# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required\n'
    gpl = fill("gpl3-or-later") + ".\n\n" + fill("gpl-no-warranty") + ".  See the\nGNU General Public License for more details.\n"
    three = "Copyright (c) 2020, Some One\nAll rights reserved.\n\n" + fill("bsd-grant", 60, " * ") + "\n\n" + "\n".join(f"{k}. {fill(n, 60)}." for k, n in enumerate(("bsd-source", "bsd-binary", "bsd-endorse"), 1))
    two = "\n".join((fill("bsd-grant"), *(fill(n, 70, "  * ") + "." for n in ("bsd-source", "bsd-binary")), "", fill("bsd-warranty") + "."))
    one_line = " ".join(license_data.TEXTS[n] + x for n, x in (("mit-grant", ""), ("mit-notice", "."), ("mit-warranty", ".")))
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
    isc = "Copyright (c) 2020\n\n" + fill("isc-grant") + ".\n\n" + fill("isc-warranty") + ". IN NO"
    cases = [
        (mit, "MIT"), (whole, "MIT"), (whole.replace("\n", "\r\n"), "MIT"), ("MIT License\n\n" + whole, "MIT"), (apache, "Apache-2.0"), (gpl, "GPL-3.0-or-later"), (three, "BSD-3-Clause"), (two, "BSD-2-Clause"),
        (one_line, "MIT"), (mpl, "MPL-2.0"), (isc, "ISC"), ("Distributed under the MIT license.", "MIT"), ("/* SPDX-License-Identifier: Apache-2.0 */\nint x;", "Apache-2.0"), ("MIT License", "MIT"),
        ("Licensed under the BSD 3-Clause License", "BSD-3-Clause"), (" GNU AFFERO GENERAL PUBLIC LICENSE\n    Version 3, 19 November 2007\n\n Copyright", "AGPL-3.0"), (fill("unlicense-public") + ".\n\n" + fill("unlicense-anyone", 60) + ".", "Unlicense"),
        (fill("mit-grant").replace("\n", "\n\n", 1), ""), (fill("mit-notice") + " words", ""), ("the license of MIT", ""),
    ]
    assert licensed(spark, [t for t, _ in cases]) == [n for _, n in cases]


def test_license_sentences_and_rules_fit():
    told = license_data.sentences()
    assert all(i in told for _, ids in license_data.rules() for i in ids)
    assert len(license.KNOWN) == sum(map(len, told.values()))  # no two sentences are alike
    pattern = re.compile(license.wrapped(license.KNOWN))
    assert all(pattern.search(s.replace(" ", "\n", 3)) for s in license.KNOWN)


def slow_sections(text, ends, rule, tokenizer):
    """Tokens of each section, character by character."""
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    raws = [bytes(bpe.CHAR_BYTES[c] for c in tokenizer.id_to_token(i)) for i in ids]
    holds = lambda c: next(k for k, e in enumerate(ends) if c < e)
    out = [0] * len(ends)
    for first, last in slow_spans(text, raws):
        inside = [holds(c) for c in range(first, last)]
        out[inside[0] if rule == "start" else inside[-1] if rule == "end" else min(set(inside), key=lambda k: (-inside.count(k), k))] += 1
    return out


def slow_line_ends(text):
    ends = [k + 1 for k, c in enumerate(text) if c == "\n"]
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


@pytest.mark.parametrize("rule", tokens.RULES)
def test_token_counts_of_every_line(spark, none, rule):
    plain = Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    rows = [(i, t) for i, t, *_ in corpus() if len(t or "") < 3000] + [(900, "a\n\n\nb  \n  \n c\u732b\n\u00e9\r\n"), (901, "\n"), (902, "\n\n\n x")]
    want = Counter()
    for i, t in rows:
        ends = slow_line_ends(t or "")
        for k, (a, b, n) in enumerate(zip([0, *ends], ends, slow_sections(t or "", ends, rule, plain))):
            want[(i, k, a, b - a, n)] += 1
    given = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("sections", F.lit(1))
    assert Counter(tuple(r) for r in tokens.by_line(given, BYTES, None, rule).collect()) == want
    assert tokens.by_line(none, BYTES).count() == 0


def test_token_attribution_rules():
    first, last, sections = np.array([0, 2, 7]), np.array([2, 7, 9]), np.array([3, 3, 8, 9])
    assert tokens.attribute(first, last, sections, "start").tolist() == [2, 0, 1, 0]
    assert tokens.attribute(first, last, sections, "end").tolist() == [1, 0, 1, 1]
    assert tokens.attribute(first, last, sections, "most").tolist() == [1, 0, 2, 0]
    assert tokens.attribute(np.zeros(0), np.zeros(0), np.array([0])).tolist() == [0]


@pytest.mark.parametrize("rule", tokens.RULES)
def test_token_counts_by_field(docs, rule):
    plain = Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    want = Counter()
    for i, t, *_ in corpus():
        whole = f"xx\n{t or ''}"
        for name, n in zip(("word", "text"), slow_sections(whole, [3, len(whole)], rule, plain)):
            want[(i, name, n)] += 1
    assert Counter(tuple(r) for r in tokens.by_field(docs, ["word", "text"], BYTES, rule=rule).collect()) == want
    with pytest.raises(ValueError):
        tokens.by_field(docs, [], BYTES)


def labelled(n=400):
    rnd = random.Random(1)
    rows = []
    for k in range(n):
        good = rnd.random() < 0.6
        text = prose(rnd, rnd.randint(25, 80))
        rows.append((k, text if good else (text.upper().replace(" ", "!! ") if k % 2 else text.replace(" ", "*** ")), int(good)))
    return rows


def test_classifier_is_right_on_held_out_rows(spark, docs, none):
    rows = labelled()
    texts = spark.createDataFrame([(k, t, k) for k, t, _ in rows], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in rows] + [(None, 1, 0), (5, None, 0), (10**9, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in gam.classify(texts, labels).collect()}
    assert len(got) == len(rows)
    for k, _, q in rows:
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert 0 <= got[k].score <= 1 and got[k].predicted == (got[k].score >= 0.5)
    assert np.mean([got[k].predicted == q for k, _, q in rows if got[k].held_out]) > 0.97
    assert gam.classify(docs, labels).where("score IS NULL").count() == 0
    assert gam.classify(none, labels).count() == 0
    assert gam.classify(docs, labels.limit(0)).select("score").distinct().count() == 1
    kept = gam.keep_good(texts, labels)
    assert kept.columns == texts.columns and 0 < kept.count() < len(rows)


def test_additive_model_learns_an_interaction():
    rnd = np.random.default_rng(0)
    x = rnd.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y, pairs=1)
    assert model.pairs == [(0, 1)]
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_warc_round_trip(spark):
    rnd = random.Random(2)
    same, other = "<p>" + "x\r\n\r\ny" * 30, "é" * 60
    pages = [(k, f"http://{rnd.choice('ab')}.example.com/{rnd.randint(0, 5)}?q={k % 3}#f", rnd.choice([same, other, "short", f"page {k} " * 30])) for k in range(60)]
    pages += [(100, None, None), (101, "", ""), (102, "http://x/a b\r\nWARC-Type: no", same), (None, "http://n/", same), pages[0]]
    rows = warc.archive(spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(4)).collect()
    assert len(rows) == len(pages)
    first = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    html = {i: h or "" for i, _, h in pages}
    for r in rows:
        raw = html[r.page_id].encode()
        again = r.page_id is not None and html[r.page_id] in first and first[html[r.page_id]] != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first[html[r.page_id]]) if again else ("response", None))
    order = [(r.url_key.encode(), r.captured, r.page_id is not None, r.page_id or 0) for r in rows]
    assert order == sorted(order)
    assert warc.archive(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_warc_merges_many_runs_over_many_ranges(spark):
    rnd = random.Random(8)
    pages = [(k, f"http://{'hot' if k % 3 == 0 else rnd.choice('abcdefg')}.com/{rnd.randint(0, 40)}", f"page {rnd.randint(0, 900)} " * rnd.randint(1, 30)) for k in range(3000)]
    given = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("url_key", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("file", F.lit("x"))
    path = warc.shared_path(spark, "test")
    warc.write(given.repartition(6), path, file_records=70)
    index = warc.runs(spark, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        index = warc.runs(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert index.select("run").distinct().count() > 3
    made = warc.merge(index, 300)
    parts = [r for r in made.withColumn("part", F.spark_partition_id()).collect()]
    assert len({r.part for r in parts}) > 5
    order = [(r.part, r.url_key.encode(), r.captured, r.page_id) for r in sorted(parts, key=lambda r: r.part)]
    assert [o[1:] for o in order] == sorted(o[1:] for o in order) and Counter(r.page_id for r in parts) == Counter(p[0] for p in pages)
    again = warc.archive(given, None)
    assert sorted(map(str, again.select("page_id", "record_type", "refers_to").collect())) == sorted(map(str, made.select("page_id", "record_type", "refers_to").collect()))
    forced = warc.archive(given, None, most_digests=0)
    assert sorted(map(str, again.select("page_id", "record_type", "refers_to").collect())) == sorted(map(str, forced.select("page_id", "record_type", "refers_to").collect()))


def test_warc_rolls_files_by_bytes(spark):
    pages = [(k, "http://a/", "x" * (10 if k % 2 else 300_000) + str(k)) for k in range(40)] + [(100, "http://b/", "long " * 500_000)]
    path = warc.shared_path(spark, "test")
    warc.write(spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1), path, classes=(1000, warc.FILE_BYTES // 4, 1 << 31))
    sizes = sorted(r.length for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("length").collect())
    assert len(sizes) >= 7 and sizes[-1] < 6_100_000
    rows = warc.merge(warc.runs(spark, path)).collect()
    assert {(r.page_id, r.payload_bytes) for r in rows} == {(i, len(h)) for i, _, h in pages}


def test_block_merge_holds_one_block_a_run():
    rnd = random.Random(6)
    for _ in range(20):
        runs = [sorted((rnd.randint(0, 500), k, j) for j in range(rnd.randint(1, 60))) for k in range(rnd.randint(1, 7))]
        blocks = sorted((r[k : k + 5][0], str(n), r[k : k + 5]) for n, r in enumerate(runs) for k in range(0, len(r), 5))
        merge, out = warc.BlockMerge(lambda x: x), []
        for _, run, rows in blocks:
            out += merge.take(run, rows)
        out += merge.rest()
        assert out == sorted(x for r in runs for x in r) and merge.held <= len(runs)


def test_loser_tree():
    rnd = random.Random(4)
    for k in range(12):
        runs = [sorted(rnd.randint(0, 30) for _ in range(rnd.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("HTTPS://user@www.Example.com:443/a?b=1#c") == "com,example,www)/a?b=1"
    assert warc.url_key("") == ""


def slow_fingerprint(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=3):
    up = list(range(len(prints)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(prints))]


def test_simhash_components(docs, none):
    rows = sorted(corpus(), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [slow_fingerprint(r[1]) for r in rows]
    roots = slow_components(prints)
    want = Counter((r[0], f"{p:016x}", rows[k][0]) for r, p, k in zip(rows, prints, roots))
    assert Counter(tuple(r) for r in simhash.components(docs).collect()) == want
    assert simhash.components(none).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(roots))
    assert {r.doc_id for r in kept.collect()} == {rows[k][0] for k in set(roots)}


def five_words(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or {" ".join(words)}


@pytest.mark.parametrize("run", [6, 2048])
def test_pipeline_near_copies_against_brute_force(spark, none, run):
    import corpus_pipeline

    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(5000)}"
    rows = [*corpus()]
    for k in range(12):
        base = [word() for _ in range(rnd.randint(40, 160))]
        rows.append((1000 + 20 * k, " ".join(base), "xx", "s", 1))
        for e in range(1, 12):  # one to eleven words changed: Jaccard around 0.8, far more than three bits apart
            now = list(base)
            for at in rnd.sample(range(len(now)), min(e, len(now) // 8)):
                now[at] = word()
            rows.append((1000 + 20 * k + e, " ".join(now), "xx", "s", 1))
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    sets = [five_words(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    want = sorted(str(rows[k][0]) for k in {root(k) for k in range(len(rows))})
    given = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(str(r.doc_id) for r in overlap.drop_near_copies(given, run=run).collect()) == want
    if run == 2048:
        kept = corpus_pipeline.near_dedup(spark, given, "")
        assert kept.columns == given.columns and sorted(str(r.doc_id) for r in kept.collect()) == want
        assert overlap.drop_near_copies(none).count() == 0


@pytest.mark.parametrize("run", [4, 16, 2048])
def test_links_of_dense_and_chained_fingerprints(spark, run):
    rnd = random.Random(run)
    prints = {rnd.getrandbits(64) for _ in range(80)}
    for _ in range(6):
        seed = rnd.getrandbits(64)
        for _ in range(40):  # a chain of near copies, and a cloud around its seed
            seed ^= 1 << rnd.randrange(64)
            prints |= {seed, seed ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    nodes = simhash.connect(simhash.links(df, 3, run)).collect()
    got = defaultdict(set)
    for r in nodes:
        got[r.root].add(r.node)
    want = defaultdict(set)
    for p, k in zip(signed, slow_components(prints)):
        want[k].add(p)
    assert {frozenset(s) for s in got.values()} == {frozenset(s) for s in want.values() if len(s) > 1}


def test_bit_sliced_distance():
    rnd = np.random.default_rng(1)
    a, b = (rnd.integers(0, 1 << 63, 130, dtype=np.uint64) for _ in range(2))
    b[::3] = a[::3] ^ (np.uint64(1) << rnd.integers(0, 64, len(a[::3]), dtype=np.uint64))
    alive = np.full(3, np.uint64(2**64 - 1))
    for radius in (*range(1, 8), 15, 22, 31):
        hit = simhash.within(simhash.planes_of(a), simhash.planes_of(b), alive, radius)
        got = np.unpackbits(hit.view(np.uint8), bitorder="little")[: len(a)].astype(bool)
        assert (got == (np.bitwise_count(a ^ b) <= radius)).all()


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup(docs, none):
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[bare(t)].append((-len(t or ""), i is None, i or 0, i))
    want = Counter()
    for i, t, *_ in corpus():
        g = groups[bare(t)]
        want[(i, min(g)[3], len(g), hashlib.sha256(bare(t).encode()).hexdigest())] += 1
    rows = dedup.decisions(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    kept = dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(min(g)[3] for g in groups.values())
    assert dedup.decisions(none).count() == 0 and dedup.drop_copies(none).count() == 0


@pytest.mark.parametrize("slice_words", [0, 256, dedup.SLICE_WORDS])
def test_exact_dedup_with_a_filter_in_slices(docs, slice_words):
    assert Counter(map(tuple, dedup.decisions(docs, slice_words=slice_words).collect())) == Counter(map(tuple, dedup.decisions(docs).collect()))
    assert Counter(r.doc_id for r in dedup.drop_copies(docs, slice_words=slice_words).collect()) == Counter(r.doc_id for r in dedup.drop_copies(docs).collect())


def test_probe_in_slices_moves_no_row(spark):
    keys = spark.createDataFrame([(str(k % 700),) for k in range(9000)], "sha string")
    patterns = dedup.repeated(keys, "sha", 9000).cache()
    for slice_words in (0, dedup.SLICE_WORDS):
        plan = dedup.probe(keys, patterns, "sha", 9000, "possible", slice_words)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_ties_of_copies_do_not_depend_on_arrival(spark):
    rows = [(1, "same text", "a"), (1, "same text", "b"), (1, "same  text", "c"), (1, "same  text", "d"), (2, "other", "e")]
    kept = set()
    for k in range(4):
        df = spark.createDataFrame(rows[k:] + rows[:k], "doc_id bigint, text string, more string").repartition(3)
        kept.add(str(sorted(map(tuple, dedup.drop_copies(df).collect()))))
        kept.add(str(sorted(map(tuple, simhash.drop_near_copies(df).collect()))) + "near")
    assert len(kept) == 2


def test_bloom_filter_misses_no_copy(spark):
    keys = spark.createDataFrame([(str(k % 700),) for k in range(1000)], "sha string")
    patterns = dedup.repeated(keys, "sha", 1000).cache()
    probed = dedup.probe(keys, patterns, "sha", 1000, "possible")
    flags = {r.sha: r.possible for r in probed.collect()}
    assert all(flags[str(k)] for k in range(300))
    assert sum(flags[str(k)] for k in range(300, 700)) < 100


def slow_base(text):
    text = text or ""
    words, seen, twice = WORD.findall(text), set(), 0
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_rules(spark, docs, none):
    trusted = spark.createDataFrame([(k,) for k in range(5, 30)] + [(None,), (7,)], "doc_id bigint")
    rows = rules.judge(docs, trusted).collect()
    want = Counter((i, *slow_base(t)) for i, t, *_ in corpus())
    assert Counter(tuple(r)[:7] for r in rows) == want
    assert all(not r.kept for r in rows if r.base_failed)
    kept = rules.keep_clean(docs, trusted)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)
    assert rules.judge(none, trusted).count() == 0
    assert all(r.ratio == 0 for r in rules.judge(docs, trusted.limit(0)).collect())
    assert rules.weights(docs, trusted, most_ids=0) == rules.weights(docs, trusted) == rules.weights(docs, trusted, most_ids=3)
    assert rules.buckets_of(docs) == rules.LEAST_BUCKETS < rules.buckets_of(spark.range(40_000).select(F.repeat(F.lit("x"), 1000).alias("text")))


def test_ratio_against_counts_by_hand(spark):
    rows = labelled(300)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")
    trusted = spark.createDataFrame([(k,) for k, _, q in rows if q], "doc_id bigint")
    def bucket(*words):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return h & (rules.LEAST_BUCKETS - 1)

    raw, good = Counter(), Counter()
    grams = {}
    for k, t, q in rows:
        words = WORD.findall(t)
        grams[k] = [bucket(w) for w in words] + [bucket(a, b) for a, b in zip(words, words[1:])]
        raw.update(grams[k])
        if q:
            good.update(grams[k])
    g, r = sum(good.values()), sum(raw.values())
    weight = lambda b: round(1e6 * np.log((good[b] + rules.SMOOTHING) / (raw[b] * g / r + rules.SMOOTHING)))
    got = {x.doc_id: x for x in rules.judge(docs, trusted).collect()}
    for k in grams:
        assert got[k].ratio == pytest.approx(sum(map(weight, grams[k])) / len(grams[k]) / 1e6, abs=1e-6)
        assert got[k].kept == (not got[k].base_failed and got[k].ratio * 1e6 >= rules.THRESHOLD)
    assert np.mean([got[k].kept == bool(q) for k, _, q in rows]) > 0.9


@pytest.mark.parametrize("size", [7, 64, 4096])
def test_packing(docs, none, size):
    plain = Tokenizer.from_file(WORDS)
    plain.encode_special_tokens = True
    want = Counter()
    for i, t, *_ in corpus():
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), size):
            part = np.array(ids[k : k + size], "<u4").tobytes()
            want[(i, k // size, k, len(part) // 4, zlib.crc32(part))] += 1
    rows = packing.pack(docs, WORDS, size).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for at in places.values():
        at.sort()
        assert [o for o, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))]
        assert sum(n for _, n in at) <= size
    assert len(places) <= 1.15 * sum(r.length for r in rows) / size + 2
    assert packing.pack(none, WORDS, size).count() == 0


def test_packing_odd_strings():
    plain, own, rnd = Tokenizer.from_file(WORDS), packing.word_codec(WORDS), random.Random(6)
    plain.encode_special_tokens = True
    bits = [*" \n\tab'sTé猫😀́ \x85\x1c1²ǅ…,!İΣÀÿ×", "don't", "<|endoftext|>", "하"]
    for _ in range(1500):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_plan_is_whole_and_near_the_bound():
    rnd = random.Random(9)
    lengths = Counter(min(4096, int(rnd.lognormvariate(6.3, 1.0)) + 1) for _ in range(30_000))
    plan = packing.make_plan(lengths, 4096)
    used = Counter()
    for kind, n in plan.kinds:
        assert sum(kind) <= 4096 and n > 0
        for length in kind:
            used[length] += n
    assert used == lengths
    assert plan.sequences() <= 1.01 * sum(k * n for k, n in lengths.items()) / 4096 + 1


def test_nnls():
    rnd = np.random.default_rng(3)
    a = rnd.random((30, 12))
    x = np.maximum(rnd.normal(size=12), 0)
    assert np.allclose(packing.nnls(a, a @ x, close=1e-12), x, atol=1e-6)
