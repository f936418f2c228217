"""Personal data: base patterns that are always redacted, and look-alikes that boosted trees add.

High-recall generators propose spans that may overlap each other and the base spans: spelled-out addresses, and every
stretch of consecutive digit groups that may be a phone or card number, so that neither a neighbouring number nor a
date hides one. Gradient boosted trees over format and context features learn, from a bounded sample, to tell personal
data from numbers in prose. Positive are candidates that overlap a base match or are valid by themselves, and base
matches rewritten in other notations; negative are the rest, but for spelled-out addresses and those led by a cue
word, which have no label.
A candidate beside the base matches that scores above the threshold, calibrated on all held-out candidates, is added.
All of it is SQL functions and MLlib transformers.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import cut, row_key

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with what makes them linear in Java: possessive repeats, and starts only where a run begins or
#: the last match ended (a start inside a run fails like the run's own).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of more candidates than the base patterns: spelled-out addresses, and runs of digit groups.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?@\x20?|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:\x20?\.\x20?|\[\.\]|\(dot\))[0-9]{1,3}){3}(?![0-9])",
    "run": r"[0-9]++(?:[\x20().-]{1,3}[0-9]++)*+",
}
DIGITS = {"phone": (8, 15), "card": (13, 19)}  #: digits of a candidate of consecutive groups, from and to
CUE = r"(?i)mail|phone|tel|call|fax|card|visa|address|host|contact|ip|rufen|nummer|karte|carte|appel|tarjeta|llam"
FEATURES = ("kind", "length", "digits", "groups", "dots", "dashes", "spaces", "parens", "words", "distinct_digits", "longest_run", "shortest_run", "checksum", "cue", "before_space", "after_space", "line_start", "touches_number")
SAMPLE_ROWS = 20_000  #: candidates that the trees are fitted on, at most
PRECISION = 0.98
BLOCK = 256


def _running(lengths: Column) -> Column:
    """Sums of all earlier entries, in blocks so that a very long array costs no square of its length."""
    add = lambda from_: lambda xs: F.aggregate(xs, F.struct(from_.alias("at"), F.array().cast("array<int>").alias("all")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))["all"]
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(lengths) - 1, F.lit(0)) / BLOCK).cast("int")), lambda i: F.slice(lengths, (i * BLOCK + 1).cast("int"), BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
    return F.flatten(F.zip_with(blocks, add(F.lit(0))(sums), lambda b, at: add(at)(b)))


#: a match: kind, code points from and to, itself, what stands before (24 characters at most) and after it (one)
MATCH = "array<struct<kind:string,start:int,end:int,said:string,before:string,after:string>>"


def matched(rows: DataFrame, text: str, patterns: dict[str, tuple[str, str, str]]) -> DataFrame:
    """`rows` with an array of all matches for each name in `patterns`: (kind, pattern, what the text must have for one).

    Each stage is a projection of its own, so that every pattern runs twice over a text that can match, and else not.
    """
    can = {n: F.col(text).rlike(needs) for n, (_, _, needs) in patterns.items()}
    names = list(patterns)
    rows = rows.select("*", *[F.when(can[n], F.regexp_extract_all(text, F.lit(patterns[n][1]), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"{n}_said") for n in names])
    rows = rows.select("*", *[F.when(F.size(f"{n}_said") > 0, F.split(text, patterns[n][1], -1)).otherwise(F.array().cast("array<string>")).alias(f"{n}_gaps") for n in names])
    # a text of k matches has k + 1 gaps; the last gap, past the end of `said`, has a null match
    rows = rows.select("*", *[_running(F.zip_with(f"{n}_said", f"{n}_gaps", lambda m, g: F.coalesce(F.length(m), F.lit(0)) + F.length(g))).alias(f"{n}_at") for n in names])

    def placed(n: str) -> Column:
        def match(m: Column, i: Column) -> Column:
            gap = F.get(f"{n}_gaps", i)
            start = F.get(f"{n}_at", i) + F.length(gap)
            return F.struct(F.lit(patterns[n][0]).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("said"), F.right(gap, F.lit(24)).alias("before"), F.left(F.get(f"{n}_gaps", i + 1), F.lit(1)).alias("after"))

        return F.transform(f"{n}_said", match).cast(MATCH)

    made = [f"{n}_{x}" for n in names for x in ("said", "gaps", "at")]
    return rows.select("*", *[placed(n).alias(n) for n in names]).drop(*made)


def digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    each = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.substr(number, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def valid(m: Column) -> Column:
    """Whether a match of a base pattern counts."""
    n, part = F.length(digits(m["said"])), "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(m["kind"] == "ip", m["said"].rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(m["kind"] == "card", F.when((n >= 14) & (n <= 19), luhn(digits(m["said"]))).otherwise(False))
        .when(m["kind"] == "phone", (n >= 10) & (n <= 15))
        .otherwise(True)
    )


def scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, doc_id, base, loose, runs): base spans, spelled-out candidates and runs of digit groups of every whole text."""
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).alias("doc_id"), said.alias("said"))
    needs = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]"}
    patterns = {k: (k, BASE[k], needs[k]) for k in KINDS}
    patterns |= {"loose_email": ("email", LOOSE["email"], r"@|[(\[]at[)\]]"), "loose_ip": ("ip", LOOSE["ip"], r"[0-9](?:\x20?\.\x20?|\[\.\]|\(dot\))[0-9]"), "runs": ("run", LOOSE["run"], r"[0-9](?:[\x20().-]{0,3}[0-9]){7}")}
    rows = matched(rows, "said", patterns).drop("said")
    rows = rows.select("key", "doc_id", F.filter(F.concat(*KINDS), valid).alias("base"), F.concat("loose_email", "loose_ip").alias("loose"), F.filter("runs", lambda r: F.length(digits(r["said"])) >= DIGITS["phone"][0]).alias("runs"))
    return rows.select("key", "doc_id", F.transform("base", lambda m: F.struct(m["kind"], m["start"], m["end"])).alias("base"), "loose", "runs")


def stretches(rows: DataFrame) -> DataFrame:
    """Every stretch of consecutive digit groups of the run `r` that has as many digits as a kind allows, as column `c`.

    A stretch starts at any group and has 19 digits at most, so a run has at most 19 stretches for each of its groups,
    and each start carries only the groups that it can reach.
    """
    most, back = DIGITS["card"][1], 27
    g = rows.withColumn("g", F.regexp_extract_all("r.said", F.lit("[0-9]+"), F.lit(0))).withColumn("gap", F.split("r.said", "[0-9]+", -1))
    g = g.withColumn("at", _running(F.zip_with("g", F.slice("gap", 2, F.size("g")), lambda d, s: F.length(d) + F.length(s))))

    def reach(at: Column, i: Column) -> Column:
        led = F.substr("r.said", F.greatest(at - back, F.lit(0)) + 1, F.least(at, F.lit(back)))
        before = F.when(at < back, F.concat("r.before", led)).otherwise(led)
        return F.struct((F.col("r.start") + at).alias("start"), before.alias("before"), F.slice("g", i + 1, most).alias("g"), F.slice("gap", i + 2, most).alias("gap"))

    starts = g.select("key", "base", F.col("r.after").alias("end"), F.explode(F.transform("at", reach)).alias("s"))
    starts = starts.select("key", "base", "s", F.concat("s.gap", F.array("end")).alias("next"))
    sums = lambda xs: F.transform(F.sequence(F.lit(1), F.size(xs)), lambda k: F.aggregate(F.slice(xs, F.lit(1), k), F.lit(0), lambda t, x: t + F.length(x)))
    starts = starts.withColumn("n", sums(F.col("s.g"))).withColumn("m", F.concat(F.array(F.lit(0)), sums(F.col("s.gap"))))
    each = starts.select("key", "base", "s", "next", F.explode(F.transform("n", lambda n, k: F.struct(n.alias("n"), (k + 1).alias("k"), (n + F.get("m", k)).alias("length")))).alias("e"))
    each = each.where(F.col("e.n").between(DIGITS["phone"][0], most))
    said = F.array_join(F.flatten(F.zip_with(F.slice("s.g", F.lit(1), F.col("e.k")), F.concat(F.slice("s.gap", F.lit(1), F.col("e.k") - 1), F.array(F.lit(""))), lambda d, p: F.array(d, p))), "")
    after = F.left(F.get("next", F.col("e.k") - 1), F.lit(1))
    lead = F.length(F.regexp_extract("s.before", r"\+?\(?$", 0))
    kinds = F.array_compact(F.array(*[F.when(F.col("e.n").between(*DIGITS[k]), k) for k in DIGITS]))
    each = each.select("*", F.explode(kinds).alias("k"), lead.alias("lead"), said.alias("said"), after.alias("after"))
    whole = F.concat(F.right("s.before", F.col("lead")), "said")
    before = F.right(F.left("s.before", F.length("s.before") - F.col("lead")), F.lit(24))
    c = F.struct(F.col("k").alias("kind"), (F.col("s.start") - F.col("lead")).cast("int").alias("start"), (F.col("s.start") + F.col("e.length")).cast("int").alias("end"), whole.alias("said"), before.alias("before"), F.col("after").alias("after"))
    return each.select("key", "base", c.alias("c"))


def rewritten(c: Column) -> Column:
    """A base match in other notations, as an array of candidates."""
    n, said = digits(c["said"]), c["said"]
    fours = lambda by: F.regexp_replace(F.regexp_replace(n, "([0-9]{4})(?=[0-9])", rf"$1{by}"), r"[\s]+$", "")
    forms = {
        "email": [F.regexp_replace(said, "@", "(at)"), F.regexp_replace(said, "@", " @ ")],
        "ip": [F.regexp_replace(said, r"\.", "[.]"), F.regexp_replace(said, r"\.", " . ")],
        "card": [fours("."), fours("-"), fours(" ")],
        "phone": [F.regexp_replace(said, r"^\+", ""), F.regexp_replace(F.regexp_replace(said, r"[+()]", ""), "[ -]+", ".")],
    }
    none = F.array().cast("array<string>")
    made = F.coalesce(*[F.when(c["kind"] == k, F.array(*v)) for k, v in forms.items()], none)
    return F.transform(made, lambda v: c.withField("said", v))


def featured(candidates: DataFrame) -> DataFrame:
    """Format and context features of column `c`."""
    c, n = F.col("c"), digits(F.col("c.said"))
    count = lambda what: F.regexp_count("c.said", F.lit(what))
    features = {
        "kind": F.array_position(F.array(*[F.lit(k) for k in KINDS]), c["kind"]),
        "length": F.length("c.said"),
        "digits": F.length(n),
        "groups": count("[0-9]+"),
        "dots": count(r"\."),
        "dashes": count("-"),
        "spaces": count(" "),
        "parens": count(r"[()]"),
        "words": count("[A-Za-z]+"),
        "distinct_digits": F.size(F.array_distinct(F.split(n, ""))),
        "longest_run": F.array_max(F.transform(F.split("c.said", "[^0-9]"), lambda r: F.length(r))),
        "shortest_run": F.coalesce(F.array_min(F.transform(F.regexp_extract_all("c.said", F.lit("[0-9]+"), F.lit(0)), lambda r: F.length(r))), F.lit(0)),
        "checksum": F.when(F.length(n).between(13, 19), luhn(n).cast("int")).otherwise(0),
        "touches_number": (c["before"].rlike(r"[0-9][\x20().-]{0,3}$") | c["after"].rlike("[0-9]")).cast("int"),
        "cue": c["before"].rlike(CUE).cast("int"),
        "before_space": c["before"].rlike(r"\s$").cast("int"),
        "after_space": c["after"].rlike(r"^\s").cast("int"),
        "line_start": (c["before"].rlike(r"\n$") | (c["start"] == 0)).cast("int"),
    }
    rows = candidates.select("*", *[features[f].cast("double").alias(f) for f in FEATURES])
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).drop(*FEATURES)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def labelled(each: DataFrame) -> DataFrame:
    """Featured candidates with a `label` (1, 0 or null) and `made`: whether they are rewritten base matches."""
    c, hit = F.col("c"), F.exists("base", lambda b: overlaps(b, F.col("c")))
    sound = F.when(c["kind"] == "email", c["said"].rlike(f"^{BASE['email']}$")).when((c["kind"] == "phone") & ~c["said"].startswith("+"), False).otherwise(valid(c))
    spelled = c["kind"].isin("email", "ip") & c["said"].rlike(r"[\x20()\[\]]")
    label = F.when(hit | sound, 1.0).when(~spelled & ~c["before"].rlike(CUE), 0.0)
    marked = each.select("key", "c", hit.alias("hit"), label.alias("label"), F.exists("base", lambda b: (b["kind"] == c["kind"]) & (b["start"] == c["start"]) & (b["end"] == c["end"])).alias("own"))
    made = marked.where("own").select("key", F.explode(rewritten(F.col("c"))).alias("c"), F.lit(True).alias("hit"), F.lit(1.0).alias("label"), F.lit(True).alias("made"))
    return featured(marked.select("key", "c", "hit", "label", F.lit(False).alias("made")).union(made))


def fit(candidates: DataFrame) -> tuple[GBTClassificationModel | None, float]:
    """Trees from a sample of featured candidates with a `label`, and the threshold that keeps the precision on all others.

    A quarter of the candidates, by hash, is held out; of the rest the SAMPLE_ROWS of smallest hash are fitted. No
    trees where the sample has one label only.
    """
    known = candidates.where("label is not null").withColumn("h", F.xxhash64("key", "c"))
    sample = cut(known.where(F.pmod("h", F.lit(4)) != 0).select("features", "label", "h").orderBy("h").limit(SAMPLE_ROWS))
    if sample.select("label").distinct().count() < 2:
        return None, 1.0
    model = GBTClassifier(maxIter=10, maxDepth=4, seed=1, checkpointInterval=-1).fit(sample)
    held = model.transform(known.where(F.pmod("h", F.lit(4)) == 0)).select("label", F.floor(vector_to_array("probability")[1] * 100).alias("bin"))
    bins = sorted(((r.bin, r.n, r.hits) for r in held.groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("hits")).collect()), reverse=True)
    threshold, n, hits = 1.0, 0, 0
    for low, more, good in bins:  # 101 bins at most: the lowest threshold down to which the precision holds
        n, hits = n + more, hits + good
        if hits < PRECISION * n:
            break
        threshold = low / 100
    return model, threshold


def apart(spans: Column) -> Column:
    """Of spans (start, p, end, kind) in order, those that stay when each overlap goes to the better: one sweep."""
    first = F.struct(F.slice(spans, 1, 0).alias("done"), F.get(spans, 0).alias("open"))

    def step(state: Column, s: Column) -> Column:
        clash = s["start"] < state["open"]["end"]
        better = F.when(s["p"] < state["open"]["p"], s).otherwise(state["open"])
        return F.struct(F.when(clash, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"]))).alias("done"), F.when(clash, better).otherwise(s).alias("open"))

    return F.aggregate(F.slice(spans, F.lit(2), F.size(spans)), first, step, lambda s: F.concat(s["done"], F.array(s["open"])))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, added) for each row of `docs`: arrays of (kind, start, end) in code points, by start and kind.

    Added spans overlap neither base spans nor each other: of two that do, the likelier stays, the earlier at a tie.
    Null and empty texts have none. Rows that repeat another row wholly have equal spans. Other columns are left out.
    """
    scanned = cut(scan(docs, doc_id, text))
    rows = scanned.where((F.size("loose") > 0) | (F.size("runs") > 0))
    each = rows.select("key", "base", F.explode("loose").alias("c")).union(stretches(rows.select("key", "base", F.explode("runs").alias("r"))))
    known = cut(labelled(each.dropDuplicates(["key", "c"])))  # read for the sample, the threshold and the result
    model, threshold = fit(known)
    rank = lambda kind: F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
    ordered = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], rank(s["kind"]).alias("rank"), s["kind"], s["end"]))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    if model is None:
        return scanned.select("doc_id", ordered(F.col("base")).alias("base"), F.slice("base", 1, 0).alias("added"))
    likely = model.transform(known.where("not hit and not made")).withColumn("p", vector_to_array("probability")[1]).where(F.col("p") >= threshold)
    chosen = likely.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("c.start").alias("start"), (-F.col("p")).alias("p"), F.col("c.end").alias("end"), F.col("c.kind").alias("kind")))).alias("all"))
    extra = chosen.select("key", F.transform(apart(F.col("all")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("extra"))
    out = scanned.select("key", "doc_id", "base").join(extra, "key", "left")
    return out.select("doc_id", ordered(F.col("base")).alias("base"), ordered(F.coalesce("extra", F.slice("base", 1, 0))).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
