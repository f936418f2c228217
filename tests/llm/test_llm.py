"""Training-data operators against brute force, on small hard tables: nulls, empty and long texts, ties, repeats, clashing names."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from stepfold.llm import chat, decontam, exchange, graph, lines, lm, mixing, pii, queries, search, simhash, substrings, toxicity
from tests.agree import assert_agree

WORDS = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, key string, row string, score double"


def docs_of(spark, texts, sources=None):
    """Documents with extra columns whose names clash with internal ones."""
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[k], len(t or ""), "c", "k", "r", 0.5) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def some_text(rng, n):
    return " ".join(f"w{int(x)}" for x in rng.integers(0, 400, n))


@pytest.fixture(scope="module")
def hard(spark):
    rng = np.random.default_rng(5)
    shared = some_text(rng, 60)
    texts = [some_text(rng, int(n)) for n in rng.integers(1, 90, 30)]
    texts += [shared, some_text(rng, 5) + "\n" + shared, shared.replace("w1", "W1"), shared, "é ü ß " * 40, "", None, " \t\n ", "one two", some_text(rng, 20_000), ("ab " * 36) + "tail"]
    rows = list(enumerate(texts)) + [(None, shared), (3, texts[3]), (3, texts[3])]
    return rows, docs_of(spark, rows, [f"s{i % 4}" if i % 9 else None for i in range(len(rows))])


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\[\\\\<", "", None, "<|end|>\n<|turn|>user<|text|>", "é日本\U0001f600<", "x" * 50_000]
    rows = [(1, i, r, t, "z") for i, t in enumerate(texts) for r in ("assistant", "user")] + [(2, None, None, "a", "z"), (2, 0, "assistant", "b", "z"), (2, 0, "assistant", "b", "z"), (None, 1, "user", "n", "z"), (3, 1, "sys\ntem<", None, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    assert set(got) == {1, 2, 3, None}
    for conv, row in got.items():
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        assert chat.read_turns(row.formatted) == want
        assert [chat.unescape(row.formatted[s.start : s.end]) for s in row.loss] == [t for role, t in want if role == "assistant"]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_equal_rows_are_dealt_over_chunks(spark):
    """A third of the rows are one row without id: they meet by input partition only, and results stay those of brute force."""
    rng = np.random.default_rng(11)
    texts = [some_text(rng, int(n)) for n in rng.integers(36, 60, 40)]
    rows = [(None, texts[0])] * 20 + list(enumerate(texts))
    df = docs_of(spark, rows).repartition(10)
    sizes = exchange.deal(df, 256, "doc_id", "text").where("doc_id is null").groupBy("chunk").count().collect()
    assert len(sizes) >= 5 and max(r["count"] for r in sizes) < 10
    want = collections.Counter((i, n, round(s, 6)) for (i, _), (n, s) in zip(rows, brute_lm([t for _, t in rows])))
    assert collections.Counter((r.doc_id, r.n_words, round(r.log_score, 6)) for r in lm.score(df).collect()) == want
    got = substrings.remove_repeats(df).collect()
    gone = {r.doc_id for r in got if r.n_removed}
    assert gone == {None, 0} and all(r.n_removed == r.n_words for r in got if r.doc_id in gone)


def brute_lm(texts, alpha=0.4):
    ws = [WORDS(t) for t in texts]
    uni, bi = collections.Counter(w for x in ws for w in x), collections.Counter(p for x in ws for p in zip(x, x[1:]))
    total, out = sum(uni.values()), []
    for x in ws:
        u, b, rest, s = collections.Counter(x), collections.Counter(zip(x, x[1:])), total - len(x), 0.0
        for i, w in enumerate(x):
            n = uni[w] - u[w]
            one = np.log(n) - np.log(rest) if n > 0 else -np.log1p(rest)
            if i == 0:
                s += one
            else:
                c = bi[(x[i - 1], w)] - b[(x[i - 1], w)]
                s += np.log(c) - np.log(uni[x[i - 1]] - u[x[i - 1]]) if c > 0 else one + np.log(alpha)
        out.append((len(x), s))
    return out


def test_lm_against_brute_force(spark, hard):
    rows, df = hard
    want = collections.Counter((i, n, round(s, 6)) for (i, _), (n, s) in zip(rows, brute_lm([t for _, t in rows])))
    assert collections.Counter((r.doc_id, r.n_words, round(r.log_score, 6)) for r in lm.score(df).collect()) == want
    assert lm.score(df.limit(0)).count() == 0


def test_lm_trigrams_against_brute_force(spark, hard):
    rows, df = hard
    ws = [WORDS(t) for _, t in rows]
    count = lambda x, n: collections.Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
    every = {n: sum((count(x, n) for x in ws), collections.Counter()) for n in (1, 2, 3)}
    want = collections.Counter()
    for (d, _), x in zip(rows, ws):
        own, rest, total = {n: count(x, n) for n in (1, 2, 3)}, sum(map(len, ws)) - len(x), 0.0
        left = lambda g: every[len(g)][g] - own[len(g)][g]
        for i in range(len(x)):
            seen = [tuple(x[i - n + 1 : i + 1]) for n in (1, 2, 3) if i >= n - 1]
            s = np.log(left(seen[0])) - np.log(rest) if left(seen[0]) > 0 else -np.log1p(rest)
            for g in seen[1:]:
                s = np.log(left(g)) - np.log(left(g[:-1])) if left(g) > 0 else s + np.log(0.4)
            total += s
        want[d, len(x), round(total, 6)] += 1
    got = lm.score(df, order=3).collect()
    assert collections.Counter((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got) == want
    assert "op2_lm_score_trigrams" in queries.QUERIES


def test_lines(spark):
    rows = [(i, f"own {i}\n the line \n\nlast {i}", "en", f"s{i}", 0) for i in range(6)] + [(9, None, "en", "s1", 0), (10, "", "en", None, 0), (None, "the line", "en", None, 0), (11, "the line\nthe line", "en", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, said long")
    got = {r.doc_id: r for r in lines.remove_boilerplate(df, min_sites=6, counts=True).collect()}
    assert got[0].text == rows[0][1] and got[3].text == "own 3\n\nlast 3" and got[9].text is None and got[9].n_lines == 0
    assert got[None].text == "" and got[11].text == "" and got[11].n_removed == 2 and got[10].text == ""
    assert lines.remove_boilerplate(df, min_sites=9).where("text like '%the line%'").count() == 8
    assert lines.remove_boilerplate(df.limit(0)).columns == df.columns


def test_near_threshold_lines_are_exact(spark):
    rows = [(f"l{n}", f"site{s}") for n in range(70, 131) for s in range(n)]
    got = lines.boilerplate(spark.createDataFrame(rows, "line string, site string"), 100)
    assert sorted(r.line for r in got.collect()) == sorted(f"l{n}" for n in range(100, 131))


def test_mixing_properties(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (sorted(map(tuple, mixing.mix(docs).drop("key").collect())) for _ in range(2))
    assert a == b and len(a) == docs.count()
    by = collections.defaultdict(list)
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for i, size, _, target, copies, taken in a:
        assert taken == copies * size <= 2 * size
        by[source[i]].append((size, target, taken))
    size = {s: sum(x[0] for x in v) for s, v in by.items()}
    target, fixed = {}, set()
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(by))}
    while True:
        left, w = 1.5 * sum(size.values()) - sum(2 * size[s] for s in fixed), sum(weight[s] for s in by if s not in fixed)
        target = {s: 2 * size[s] if s in fixed else left * weight[s] / w for s in by}
        over = {s for s in by if target[s] > 2 * size[s]}
        if not over:
            break
        fixed |= over
    for s, v in by.items():
        assert v[0][1] == pytest.approx(target[s])
        assert abs(sum(x[2] for x in v) - target[s]) <= max(x[0] for x in v)


def test_mixing_hard_rows(spark, hard):
    rows, df = hard
    out = mixing.mix(df).collect()
    assert collections.Counter((r.doc_id, r["size"]) for r in out) == collections.Counter((i, len(WORDS(t))) for i, t in rows)
    assert mixing.materialize(df, mixing.mix(df)).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


def brute_contained(docs, items):
    shingle = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for i, t in items:
        w = WORDS((t or "").lower())
        k = min(5, len(w))
        if k:
            s = shingle(w, k)
            for j, (d, x) in enumerate(docs):
                n = len(s & shingle(WORDS((x or "").lower()), k))
                if n >= 0.8 * len(s) - 1e-9:
                    out.add((d, i, len(s), n))
    return out


def test_decontamination(spark, hard):
    rows, df = hard
    rng = np.random.default_rng(11)
    item = some_text(rng, 40)
    broken = item.split()
    broken[20] = "other"
    docs = [*rows, (100, f"{some_text(rng, 300)} {item.upper()} {some_text(rng, 9000)}"), (101, " ".join(broken)), (102, " ".join(item.split()[:30]))]
    items = [(1, item), (2, item), (3, "one two"), (4, None), (5, ""), (6, rows[0][1]), (7, some_text(rng, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    every = docs_of(spark, docs)
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in decontam.contained(every, bench).collect()}
    assert got == brute_contained(docs, items) and (101, 1, 36, 31) in got and not any(d == 102 and i == 1 for d, i, _, _ in got)
    bad = {d for d, *_ in got}
    assert {r.doc_id for r in decontam.decontaminate(every, bench).collect()} == {d for d, _ in docs} - bad
    assert decontam.contained(every, bench.limit(0)).count() == 0 and decontam.contained(every.limit(0), bench).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(2 * int(c) - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_pii_base_spans(spark):
    texts = ["a@b@c.d x@y.z@w.v ..p%+@q-.r.s_t@u.v", "1.2.3.4.5.6.7.8 300.1.1.1 12.34.56 0001.2.3.04", "4111 1111 1111 1111 2 4111-1111-1111-1111 4242424242424242", "+1 (234) 567-8901)) +44.20.7946.0958- +1" + "2" * 30, "9" * 20_000 + " é" + "1-" * 5000, "x" * 30_000 + "@a.b", "", None, "日本 a@b.co +1234567890 é 1.1.1.1\U0001f600 4242424242424242", "1 22 333 " * 900]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, base string, c string")
    for r in pii.find(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.base] == brute_pii(texts[r.doc_id])
        assert not any(a.start < b.end and b.start < a.end for a in r.added for b in r.base)
    assert pii.find(df.limit(0)).count() == 0


def with_check_digit(number):
    return next(number + str(k) for k in range(10) if sum(2 * int(c) - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(number + str(k)))) % 10 == 0)


def test_pii_adds_planted_spans(spark):
    """Forms that no base pattern takes: recall of 0.9 of them, and prose numbers left alone."""
    rng = np.random.default_rng(21)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    prose = lambda: some_text(rng, 6).replace("w", "v")
    rows, planted, clean = [], {}, set()
    for i in range(720):
        card, phone = with_check_digit("4" + digits(14)), f"({digits(3)}) 555-{digits(4)}"
        name, host = f"ann.{i}", f"mail{i % 9}.example.com"
        k = i % 12
        form = [f"+1 {phone}", f"{name}@{host}", card, f"{rng.integers(1, 255)}.{rng.integers(1, 255)}.{rng.integers(1, 255)}.7"][i % 4] if k < 6 else None
        if k in (6, 7):
            other = with_check_digit("5" + digits(14))
            form, planted[i] = f"{card} {other}", [card, other]
        elif k == 8:
            form, planted[i] = f"{name}(at){host}", [f"{name}(at){host}"]
        elif k == 9:
            form, planted[i] = f"{card} 2024", [card]
        elif form is None:
            form = f"in {rng.integers(1800, 2030)} about {rng.integers(1, 999)},{digits(3)} of {digits(9)} v"
            clean.add(i)
        rows.append((i, f"{prose()} {form} {prose()}"))
    texts = dict(rows)
    hits = wrong = 0
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        added = [texts[r.doc_id][s.start : s.end] for s in r.added]
        hits += sum(p in added for p in planted.get(r.doc_id, ()))
        wrong += r.doc_id in clean and bool(added)
    assert hits >= 0.9 * sum(map(len, planted.values())) and wrong <= 0.02 * len(clean)


def test_pii_query(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op6_pii"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = brute_pii(d.text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in want) for x in pii.KINDS]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_substrings_against_brute_force(spark, hard):
    rows, df = hard
    ws = [WORDS(t) for _, t in rows]
    n = collections.Counter(tuple(w[i : i + 35]) for w in ws for i in range(len(w) - 34))
    want = []
    for (d, _), w in zip(rows, ws):
        gone = set()
        for i in range(len(w) - 34):
            if n[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = substrings.remove_repeats(df).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == collections.Counter(want)
    for r in got:
        spans = [(s.start, s.end) for s in r.removed]
        assert sum(b - a for a, b in spans) == r.n_removed and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def brute_print(text):
    w = WORDS(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_against_brute_force(spark, hard):
    rows, df = hard
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min((x for x in (least.get(find(k)), d) if x is not None), default=None)
    want = collections.Counter((d, f"{p:016x}", least[find(k)]) for k, ((d, _), p) in enumerate(zip(rows, prints)))
    assert collections.Counter(map(tuple, simhash.near_duplicates(df).collect())) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == set(least.values())


def test_keep_one_tells_rows_apart_by_text(spark):
    rng = np.random.default_rng(8)
    three, five, *others = (some_text(rng, 60) for _ in range(6))
    rows = [(3, three), (5, three), (5, five), (None, others[0]), (None, others[1]), (None, others[1]), (7, others[2]), (7, others[3]), (None, three)]
    want = sorted([(3, three), (5, five), (7, others[2]), (7, others[3])]) + sorted((None, t) for t in others[:2])
    for order in (rows, rows[::-1]):
        kept = simhash.keep_one(docs_of(spark, order)).collect()
        assert sorted(((r.doc_id, r.text) for r in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1])) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_simhash_of_repeated_ids(spark):
    """Texts that share an id are linked only by their fingerprints, and the smallest id reaches the whole component."""
    rng = np.random.default_rng(12)
    a, b = (some_text(rng, 80).split() for _ in range(2))
    near = lambda w, k: " ".join([*w[:-1], f"w{k}"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (9, near(a, 1)), (2, near(b, 2)), (None, near(a, 3))]
    prints = [brute_print(t) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() > 4
    got = collections.Counter(map(tuple, simhash.near_duplicates(docs_of(spark, rows)).collect()))
    least = lambda p: min(i for q, (i, _) in zip(prints, rows) if i is not None and (p ^ q).bit_count() <= 4)
    assert got == collections.Counter((i, f"{p:016x}", least(p)) for p, (i, _) in zip(prints, rows))


def test_tiled_links_of_a_dense_ball(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    near = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (400, 2))}
    far = {int(x) for x in rng.integers(0, 1 << 63, 600)}
    every = sorted(near | far)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in every], "fp long").withColumn("label", F.col("fp"))
    want = graph.connected_components(simhash.links(df, tile=10_000)).select("node", "root")
    tiled = graph.connected_components(simhash.links(df, tile=64)).select("node", "root")
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, tiled.collect()))
    for blocks in (5, 8):
        assert sorted(map(tuple, graph.connected_components(simhash.links(df, tile=64, blocks=blocks)).select("node", "root").collect())) == sorted(map(tuple, want.collect()))
    arr = np.array(every, dtype=np.uint64)
    pairs = np.argwhere(np.triu(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 4, 1))
    root = simhash.spanning(len(arr), pairs[:, 0], pairs[:, 1])
    groups = collections.Counter(root.tolist())
    assert tiled.groupBy("root").count().count() == sum(n > 1 for n in groups.values())


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in graph.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}
    hub = spark.createDataFrame([(500, i) for i in range(1, 200)] + [(i, 500 + i) for i in range(1, 90)] + [(900, 901)], "u long, v long")
    got = {r.node: r.root for r in graph.connected_components(hub).collect()}
    assert got == {i: 1 for i in [*range(1, 200), *range(500, 590)]} | {900: 900, 901: 900}


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(4)
    bad, rows, labels = ["vile", "rotten", "filthy"], [], []
    for i in range(900):
        w = some_text(rng, int(rng.integers(20, 120))).split()
        toxic = i % 5 == 0
        if toxic:
            for k in rng.integers(0, len(w), max(2, len(w) // 20)):
                w[k] = bad[int(k) % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "vile")]
    df, marks = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, marks)
    got = toxicity.classify(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.97
    assert toxicity.drop_toxic(df, model).columns == df.columns
    assert toxicity.classify(df.limit(0), toxicity.learn(df, marks.limit(0))).count() == 0


def test_toxicity_keeps_words_rarer_than_the_commonest():
    rng = np.random.default_rng(6)
    bad, rows = ["vile", "rotten", "filthy", "beastly"], []
    for i in range(4000):
        w = some_text(rng, 40).split()
        if i % 5 == 0:
            w[3] = bad[0] if i // 5 % 16 else bad[1 + i // 240 % 3]
        rows.append((" ".join(w), int(i % 5 == 0)))
    model = toxicity.fit(rows)
    assert all(w.encode() in model.toxic and w.encode() not in model.ordinary for w in bad)
    told = lambda w: model.scores(np.array([model.features(" ".join([*some_text(rng, 20).split(), w, *some_text(rng, 19).split()]))]))[0]
    assert all(told(w) >= toxicity.THRESHOLD for w in bad) and told("plain") < toxicity.THRESHOLD


def test_toxicity_of_marked_stems_in_several_languages():
    """Toxic texts hold a stem densely, with endings of all kinds; ordinary ones hold it now and then."""
    rng = np.random.default_rng(9)
    parts = {"a": ["sche", "lich", "keit", "ver", "ein", "ung"], "b": ["tion", "eux", "ment", "elle", "pas", "vi"], "c": ["cion", "mente", "ado", "ero", "que", "ya"]}
    stems = {"a": "achlich", "b": "r\u00e9euxo", "c": "bomente"}
    word = lambda of, n: "".join(parts[of][int(k)] for k in rng.integers(0, 6, n))
    rows = []
    for i in range(3000):
        of, toxic = "abc"[i % 3], i % 7 == 0
        w = [word(of, int(n)) for n in rng.integers(1, 5, int(rng.integers(30, 400)))]
        hits = max(2, len(w) // 25) if toxic else int(rng.random() < 0.15)
        for k in rng.choice(len(w), hits, replace=False):
            w[k] = stems[of] + word(of, int(rng.integers(0, 3)))
        rows.append((of, " ".join(w), int(toxic)))
    model = toxicity.fit([(t, y) for _, t, y in rows[:2000]])
    pair = model.compressors()
    score = model.scores(np.array([model.features(t, pair) for _, t, _ in rows[2000:]]))
    for of in "abc":
        said = [(s >= toxicity.THRESHOLD, y) for s, (o, _, y) in zip(score, rows[2000:]) if o == of]
        assert np.mean([p for p, y in said if y]) >= 0.8 and np.mean([not p for p, y in said if not y]) >= 0.95


def test_toxicity_of_long_tied_and_few_texts(spark):
    long = "plain words " * 50_000
    rows = [("idiot words here", 1), ("idiot words here", 1), ("plain words here", 0), (None, 0), ("", 1)]
    model = toxicity.fit(rows)
    s = model.scores(np.array([model.features(t) for t in (long, "idiot", "", None)]))
    assert np.isfinite(s).all() and s[2] == s[3]
    one = toxicity.fit([("a b", 1), ("c d", 1)])
    assert one.scores(np.array([one.features("a b")]))[0] > 0.99
    assert toxicity.fit([]).scores(np.array([toxicity.fit([]).features("x")]))[0] < 0.01


def brute_bm25(docs, queries, k):
    ws = [(i, collections.Counter(WORDS((t or "").lower()))) for i, t in docs if i is not None]
    n, mean = len(ws), sum(sum(c.values()) for _, c in ws) / len(ws)
    df = collections.Counter(w for _, c in ws for w in c)
    out = []
    for q, t in queries:
        terms = collections.Counter(WORDS((t or "").lower()))
        s = [(-round(sum(m * np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, m in terms.items() if w in c), 6), i) for i, c in ws]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(sorted(x for x in s if x[0] < 0)[:k])]
    return out


def test_search_against_brute_force(spark, hard):
    rows, df = hard
    asked = [(i, t) for i, t in enumerate(t for _, t in rows[:45])]
    q = spark.createDataFrame(asked, "query_id long, text string")
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in search.top_k(df, q, k=5).collect())
    want = sorted(brute_bm25(rows, asked, 5))
    assert [(a[0], a[1], a[2]) for a in got] == [(a[0], a[1], a[2]) for a in want]
    assert np.allclose([a[3] for a in got], [a[3] for a in want], atol=2e-6)
    assert search.top_k(df.limit(0), q).count() == 0


def test_search_over_many_shards_and_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(17)
    rows = [(i, some_text(rng, int(n))) for i, n in enumerate(rng.integers(0, 60, 400))]
    asked = [(i, t) for i, t in rows[:25]]
    monkeypatch.setattr(search, "SHARD_DOCS", 64)
    monkeypatch.setattr(search, "QUERY_BLOCK_TERMS", 100)
    q = spark.createDataFrame(asked, "query_id long, text string")
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in search.top_k(docs_of(spark, rows), q, k=7).collect())
    assert got == [x[:3] for x in sorted(brute_bm25(rows, asked, 7))]


def test_search_scores_the_queries_of_a_batch_together(monkeypatch):
    """Frequent terms by products, rare ones by postings, give the brute force's ranks, and a block is scored once a wave."""
    for name, value in {"BLOCK_BITS": 5, "BLOCK": 32, "OFTEN": 6, "BATCH": 40, "BATCH_TERMS": 400}.items():
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(23)
    words = np.array([f"w{i}" for i in range(300)])
    rows = [(i, " ".join(words[np.minimum(rng.zipf(1.3, int(n)) - 1, 299)])) for i, n in enumerate(rng.integers(0, 40, 300))]
    rows += [(i + 300, t) for i, t in rows[:60]]
    asked = rows[::4]
    shards = [search.Shard(search.build_shard(np.array([i for i, _ in part]), [t for _, t in part]), sum(len(t.split()) for _, t in rows) / len(rows)) for part in (rows[:200], rows[200:], [(-1, "")])]
    assert any(len(m) for m in shards[0].matrix) and any((s.row < 0).any() for s in shards[:2])
    df = collections.Counter(w for _, t in rows for w in set(t.split()))
    terms, lengths = search.term_rows([t for _, t in asked])
    hashed = dict(zip((search.Words([w]).hashes()[0] for w in df), df.values()))
    n = len(rows)
    weight = terms["count"] * np.log(1 + (n - np.array([hashed[h] for h in terms.term]) + 0.5) / (np.array([hashed[h] for h in terms.term]) + 0.5))
    order = np.lexsort((terms.term, terms.doc))
    query, term, weight = terms.doc[order], terms.term[order], weight[order]
    calls = []
    plain = search.Shard._scores
    monkeypatch.setattr(search.Shard, "_scores", lambda self, b, *rest: calls.append(b) or plain(self, b, *rest))
    pieces, got = search.batches_of(query), []
    assert len(pieces) > 1 and sum(p.stop - p.start for p in pieces) == len(query)
    for rows_ in pieces:
        names, number = np.unique(query[rows_], return_inverse=True)
        top, found = np.zeros((len(names), 5)), (np.empty(0, int), np.empty(0, int), np.empty(0))
        for shard in shards:
            more = shard.search(number, *np.unique(term[rows_], return_inverse=True), weight[rows_], top)
            found = search.best(*(np.concatenate(x) for x in zip(found, more)), 5)
        got += [(asked[names[q]][0], i) for q, i in zip(found[0], found[1])]
    assert got == [(q, i) for q, _, i, _ in brute_bm25(rows, asked, 5)]
    assert len(calls) <= 3 * len(pieces) * sum(s.blocks for s in shards)  # three waves, whatever the number of queries
    assert search.batches_of(query[:0]) == []


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(name, spark, sf, duck):
    assert_agree(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name])


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        if k < 4:
            assert 0 < docs.count() <= before
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontam.contained(docs, bench).count() == 0
    assert corpus_pipeline.run(spark, sf).columns == columns


def test_pipeline_of_hard_and_empty_tables(spark, tmp_path, hard):
    rows, _ = hard
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, None, f"s{k % 3}" if k % 4 else None, None) for k, (i, t) in enumerate(rows)], kind)
    labels = spark.createDataFrame([(i, None, i % 2) for i, _ in rows[:20]] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (2, ""), (3, rows[5][1])], "item_id long, text string")
    for name, (d, x, b) in {"hard": (docs, labels.where("doc_id % 2 = 0 or doc_id is null"), items), "empty": (docs.limit(0), labels.limit(0), items.limit(0))}.items():
        for table, df in (("documents", d), ("labels", x), ("benchmark", b)):
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        texts = {t for _, t in rows}
        assert all(r.text in texts for r in out) and (bool(out) == (name == "hard"))
        assert not any(r.doc_id == rows[5][0] and r.text == rows[5][1] for r in out)
        assert max(collections.Counter(map(tuple, out)).values(), default=0) <= 2  # of two wholly equal rows one is left, taken twice at most
