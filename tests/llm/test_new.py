"""Prefix trie, quality and manifest against brute force on small hard tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfold.llm import merkle, quality, queries, trie
from stepfold.llm.common import numbered
from tests.agree import assert_agree

TURNS = "conv_id long, turn long, role string, text string, depth string, node string, name string"


def rebuilt(rows, donor, head):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    return {c: own.get(donor(c), [])[: head(c)] + ts[head(c) :] for c, ts in own.items()}


def nodes_of(convs):
    found = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            found.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for key, ids in found.items():
        below = [k for k in found if k[: len(key)] == key]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in found)]
        saved = sum((len(found[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(key))))
        children = sum(len(k) == len(key) + 1 for k in below)
        parent = min(found[key[:-1]]) if key else None
        out[min(ids), len(key)] = (parent, len(ids), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie_rows(found):
    joined = trie.nodes(found).join(trie.ends_digest(found), ["conv_id", "depth"], "left").fillna(hashlib.sha256(b"").hexdigest(), ["ends_sha256"])
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in joined.collect()}


def test_trie_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 4)
    monkeypatch.setattr(trie, "PIECE", 3)
    rng = random.Random(3)
    rows = []
    for c in range(-4, 40):
        for t in range(rng.choice([1, 2, 3, 5, 9, 17])):
            rows.append((c, t, rng.choice(["user", "user", None]), rng.choice(["a", "é", "", None] if t < 6 else ["a"])))
    rows += [(100, t, "user", "a") for t in range(37)] + [(105, None, "user", "z"), (105, None, "user", "y"), (105, 0, "user", "y"), (105, 0, "user", "y"), (None, 0, "user", "lost")]
    rows = [(*r, "d", "n", "m") for r in rows]
    df = spark.createDataFrame(rows, TURNS).repartition(7)
    donor, head = (lambda c: c - (abs(c) % 5) * (1 if c >= 0 else -1)), (lambda c: zlib.crc32(str(c).encode()) % 9)
    turns, convs = trie.placed_turns(df)
    conv = F.col("conv_id")
    got = trie_rows(trie.members(*trie.respliced(turns, convs, conv - conv % 5, F.crc32(conv.cast("string")) % 9)))
    assert got == nodes_of(rebuilt(rows, donor, head))


def test_trie_of_equal_and_no_conversations(spark):
    rows = [(c, t, "user", "same", "d", "n", "m") for c in range(300) for t in range(3)]
    df = spark.createDataFrame(rows, TURNS)
    turns, convs = trie.placed_turns(df)
    got = trie_rows(trie.members(*trie.respliced(turns, convs, F.col("conv_id"), F.lit(0))))
    assert got == nodes_of(rebuilt(rows, lambda c: c, lambda c: 0))
    turns, convs = trie.placed_turns(df.limit(0))
    assert trie_rows(trie.members(*trie.respliced(turns, convs, F.col("conv_id"), F.lit(2)))) == {}


def test_places_follow_partitions(spark):
    df = spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id")
    assert [(r.id, r.at) for r in numbered(df, "at").orderBy("id").collect()] == [(i, i) for i in range(1000)]


H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, arity):
    """Root and, for each leaf, the (left, right) siblings."""
    proofs, level, own = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(own):
            run = level[at // arity * arity : at // arity * arity + arity]
            proofs[i].append(("".join(run[: at % arity]), "".join(run[at % arity + 1 :])))
        level, own = [H(*level[i : i + arity]) for i in range(0, len(level), arity)], [at // arity for at in own]
    return level[0], proofs


@pytest.mark.parametrize("arity", [2, 8])
@pytest.mark.parametrize("n", [1, 2, 8, 9, 65, 200])
def test_fragments_merge_in_any_order(n, arity):
    """The union of fragments is associative and commutative: any tree of merges of any split ends at the one root."""
    rng = random.Random(n)
    leaves = [H(str(i)) for i in range(n)]
    bits = [[] for _ in range(5)]
    for i, leaf in enumerate(leaves):
        rng.choice(bits).append((7, n, 0, i, leaf))
    parts = [merkle.complete(b, arity)[0] for b in bits]
    while len(parts) > 1:
        rng.shuffle(parts)
        parts.append(merkle.complete([x[:5] for x in parts.pop() + parts.pop()], arity)[0])
    assert [(x[4], x[5]) for x in parts[0]] == [(tree(leaves, arity)[0], True)]


def test_neighbouring_leaves_leave_few_nodes():
    n = 100_000
    unresolved, _ = merkle.complete((0, n, 0, i, "x") for i in range(12_345, 61_234))
    assert len(unresolved) <= 14 * 6


def test_manifest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CHUNK", 16)
    monkeypatch.setattr(merkle, "FAN_IN", 3)
    rng = random.Random(4)
    rows = [(i if i % 11 else None, rng.choice(["en", "en", "en", "de", "fr", "ä", None]), f"t{i % 7}É") for i in range(700)] + [(5, "xx", None), (5, "xx", None), (5, "yy", "")]
    df = spark.createDataFrame([(*r, "p", "r", 1, "f") for r in rows], "doc_id long, lang string, text string, path string, row string, leaves int, root string").repartition(5)
    df = df.withColumn("leaf", merkle.leaf_of(F.col("doc_id"), F.col("lang"), F.col("text")))
    out = merkle.manifest(df, "lang", ["doc_id"])
    assert out.columns == ["doc_id", "lang", "text", "path", "row", "leaves", "leaf", "subroot", "root", "proof"]
    got = sorted((str(r.lang), r.leaf, r.subroot, r.root, tuple((p.left, p.right) for p in r.proof)) for r in out.collect())

    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = {}
    for doc, lang, text in rows:
        by.setdefault(lang, []).append((doc is not None, doc or 0, H(part(doc), part(lang), part(text))))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([r[2] for r in sorted(by[x])], 8) for x in langs}
    root, above = tree([trees[x][0] for x in langs], 8)
    want = sorted((str(x), r[2], trees[x][0], root, tuple(p + above[k])) for k, x in enumerate(langs) for r, p in zip(sorted(by[x]), trees[x][1]))
    assert got == want
    folded = out.select((merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"), (merkle.fold(F.lit("x"), F.col("proof")) == F.col("root")).alias("bad"))
    assert folded.distinct().collect() == [(True, False)]


def test_manifest_of_one_and_no_rows(spark):
    df = spark.createDataFrame([(1, "en")], "doc_id long, lang string").withColumn("leaf", merkle.leaf_of(F.col("doc_id")))
    (r,) = merkle.manifest(df, "lang", ["doc_id"]).collect()
    assert (r.leaf, r.subroot, r.root, r.proof) == (H("1:1"), H("1:1"), H("1:1"), [])
    assert merkle.manifest(df.limit(0), "lang", ["doc_id"]).collect() == []


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_manifest"])
def test_oracles(name, spark, sf, duck):
    assert_agree(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name])


def spoiled(rng, n):
    """A text whose one passage is junk that the invented ordinary texts never have."""
    good = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "consectetur"], n)) for _ in range(4)]
    return " ".join([*good[:2], "@@ ## " * 20, *good[2:]]), " ".join(good)


def test_quality_finds_one_bad_passage_and_where_it_is():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(150):
        bad, good = spoiled(rng, int(rng.integers(20, 90)))
        rows += [(bad, 0), (good, 1), (good[: len(good) // 2], 1)]
    model = quality.fit(rows)
    bad, good = zip(*[spoiled(rng, 60) for _ in range(40)])
    assert (model.scores(list(bad)) < 0.3).mean() > 0.95 and (model.scores(list(good)) >= 0.3).mean() > 0.95
    x = quality.encoded(bad[0])
    weight = model.bags(x, np.array([0]))[3]
    assert len(x) > 3 and abs(weight.sum() - 1) < 1e-4
    assert (model.scores(list(bad)) == quality.fit(rows).scores(list(bad))).all()


def test_quality_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    model = quality.fit([(spoiled(rng, 30)[k], k) for _ in range(12) for k in (0, 1)])
    model.layers = {k: v.astype(np.float64) for k, v in model.layers.items()}
    model.mean, model.spread = model.mean.astype(np.float64), model.spread.astype(np.float64)
    x = np.concatenate([quality.encoded(spoiled(rng, 50)[k]) for k in (0, 1)]).astype(np.float64)
    start, y = np.array([0, len(quality.encoded(spoiled(np.random.default_rng(1), 50)[0]))]), np.array([0.0, 1.0])
    got = quality._gradients(model, x, start, y)
    for name, layer in model.layers.items():
        at = np.unravel_index(np.abs(got[name]).argmax(), layer.shape)
        was, step = layer[at], 1e-6
        loss = []
        for sign in (1, -1):
            layer[at] = was + sign * step
            loss.append(quality._loss(model.bags(x, start)[-1], y))
        layer[at] = was
        assert abs((loss[0] - loss[1]) / (2 * step) - got[name][at]) < 1e-4 * max(1, abs(got[name][at]))


def test_quality_of_hard_and_few_texts(spark, monkeypatch):
    rows = [(1, "a b c"), (2, None), (3, ""), (None, "x"), (1, "a b c"), (4, "w " * 200_000), (6, "\ud800".encode("utf-8", "surrogatepass").decode("utf-8", "replace")), (8, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, 0.1, "s") for r in rows], "doc_id long, text string, quality_score double, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 0)], "doc_id long, quality int")
    out = quality.classify(docs, quality.learn(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert {r.doc_id: r.held_out for r in out} == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows}
    none = quality.classify(docs, quality.learn(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(docs.limit(0), quality.learn(docs.limit(0), labels)).count() == 0
    long = "one two three " * 20_000 + "### " * 40
    whole = quality.encoded(long)
    monkeypatch.setattr(quality, "PIECE_BYTES", 5_000)
    assert np.allclose(whole, quality.encoded(long), atol=2e-3)


def test_quality_held_out(spark):
    """Held-out labels of the larger table, by language: nine tenths of either kind on the right side."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = queries.op12_quality(spark, sf).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    share = {(r.quality): r.hit for r in judged.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("hit")).collect()}
    assert share[0] > 0.9 and share[1] > 0.97
    worst = judged.where("quality = 1").groupBy("lang").agg(F.avg("predicted").alias("kept")).agg(F.min("kept")).first()[0]
    assert worst > 0.95
