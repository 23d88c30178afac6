"""The five stages of the corpus pipeline against plain loops, with nulls, repeated rows, empty tables, long texts and clashing columns."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from test_operators import WORD, WORDS, bare, five_words, slow_base
from vitrail import session
from vitrail.llm import gam, overlap, packing, rules
from vitrail.llm.common import materialize

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, first string, node int, sha string"


def documents():
    rnd = random.Random(21)
    word = lambda: rnd.choice(["harbour", "of", "Ärger", "tower", "blue", "the", "river", "morning", "naïve", "letter", "door", "stone"]) + rnd.choice(["", "", "s", "ly"])
    texts = [None, "", " \n", "too short"]
    good = [" ".join(word() for _ in range(rnd.randint(40, 120))) + "." for _ in range(120)]
    texts += good
    texts += [t.upper().replace(" ", "!! ") for t in good[:40]]  # bad ones
    texts += [good[5], good[5].replace(" ", "  "), good[6] + "\n", " ".join(good[7].split()[:20] * 6)]
    for k in range(10, 16):
        words = good[k].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts.append(" ".join(good[20:60]))  # a long one
    rows = [(k, t, "en", "s", len(t or ""), 7, "f", 1, "x") for k, t in enumerate(texts)]
    return [*rows, rows[10], rows[10], (None, good[30], "en", "s", 1, 7, "f", 1, "x")]


def quality(k):
    return 0 if 124 <= k < 164 else 1


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, quality(k), 0) for k in range(4, 164)] + [(None, 1, 0), (50, None, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def slow_score(model, text):
    """The model's tables added up one by one."""
    at = [int(sum(v >= e for e in edges)) for v, edges in zip(gam.features(text), model.edges)]
    total = model.intercept + sum(t[b] for t, b in zip(model.tables, at)) + sum(t[at[i] // model.coarse, at[j] // model.coarse] for t, (i, j) in zip(model.pair_tables, model.pairs))
    return 1 / (1 + np.exp(-total))


def grams(text, buckets):
    def bucket(*words):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return h & (buckets - 1)

    words = WORD.findall(text or "")
    return [bucket(w) for w in words] + [bucket(a, b) for a, b in zip(words, words[1:])]


def slow_rules(rows, buckets):
    raw, good = Counter(), Counter()
    for r in rows:
        own = grams(r[1], buckets)
        raw.update(own)
        if r[0] is not None and 4 <= r[0] < 164 and quality(r[0]):
            good.update(own)
    g, n = sum(good.values()), sum(raw.values())
    weight = lambda b: round(1e6 * np.log((good[b] + rules.SMOOTHING) / (raw[b] * g / n + rules.SMOOTHING)))
    kept = []
    for r in rows:
        own = grams(r[1], buckets)
        if not slow_base(r[1])[-1] and sum(map(weight, own)) / max(1, len(own)) >= rules.THRESHOLD:
            kept.append(r)
    return kept


def order(r):
    return (r[0] is None, r[0] or 0)


def slow_near(rows):
    rows = sorted(rows, key=order)
    sets, root = [five_words(r[1]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if v in (x, y) else v for v in root]
    return [r for k, r in enumerate(rows) if root[k] == k]


def told(df):
    return Counter(map(tuple, df.collect()))


def test_stages_one_after_another(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    model = gam.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    first = materialize(stages["quality_classifier"](spark, docs, sf_dir), "t")
    assert first.columns == docs.columns
    assert told(first) == Counter(r for r in documents() if slow_score(model, r[1] or "") >= 0.5)

    second = materialize(stages["quality_rules"](spark, first, sf_dir), "t")
    left = [tuple(r) for r in first.collect()]
    assert second.columns == docs.columns and told(second) == Counter(slow_rules(left, rules.buckets_of(first)))

    third = materialize(stages["exact_dedup"](spark, second, sf_dir), "t")
    groups = defaultdict(list)
    for r in (tuple(r) for r in second.collect()):
        groups[bare(r[1])].append(r)
    assert third.columns == docs.columns and told(third) == Counter(min(g, key=lambda r: (-len(r[1] or ""), *order(r))) for g in groups.values())

    fourth = materialize(stages["near_dedup"](spark, third, sf_dir), "t")
    assert fourth.columns == docs.columns and told(fourth) == Counter(slow_near([tuple(r) for r in third.collect()]))

    plain = Tokenizer.from_file(WORDS)
    plain.encode_special_tokens = True
    want = Counter()
    for r in fourth.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[(r.doc_id, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()))] += 1
    packed = stages["pack"](spark, fourth, sf_dir).collect()
    assert Counter(tuple(r)[:5] for r in packed) == want
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf_dir).collect()) == want
    assert 0 < fourth.count() < third.count() < second.count() < docs.count()


def test_stages_on_an_empty_table(spark, sf_dir):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, none, sf_dir)
        assert made.count() == 0, name
        assert name == "pack" or made.columns == none.columns, name


def test_a_stage_writes_few_files(spark, sf_dir, tmp_path, monkeypatch):
    """Narrow tables of near_dedup and exact_dedup get as many files as their rows ask for, whatever the shuffle partitions: each file
    starts processes on a local disk, and a starting one counts an executor's memory twice."""
    docs, stages = spark.read.parquet(f"{sf_dir}/documents.parquet"), dict(corpus_pipeline.STAGES)
    want = told(stages["near_dedup"](spark, docs, sf_dir))
    monkeypatch.setattr(session, "shared_root", lambda spark: str(tmp_path))
    held = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert told(stages["near_dedup"](spark, docs, sf_dir)) == want
        stages["exact_dedup"](spark, docs, sf_dir)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = Counter(p.parent.name for p in tmp_path.rglob("part-*.parquet"))
    for table in [*(f"overlap-{x}" for x in ("nodes", "blocks", "met", "centres", "pairs", "links", "stars", "components", "groups")), "dedup-patterns"]:
        assert [n for name, n in files.items() if name.startswith(f"{table}-")] == [1], table


def test_a_worker_forgets_pieces_that_it_does_not_need(monkeypatch):
    own, made = packing.word_codec(WORDS), []
    for module in (gam, overlap):
        monkeypatch.setattr(module, "map_texts", lambda df, text, make, fields: made.append(make))
    gam.with_features(None), gam.with_scores(None, gam.Model()), overlap.with_signatures(None, "text", "n", "f", "b", "s")
    for make in made:
        ids = own.encode("harbour of stone")
        assert own.met
        make()
        assert not own.met and own.encode("harbour of stone") == ids
    assert len(made) == 3
