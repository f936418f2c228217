"""Scalar text functions: name normalisation and parsing, keys, notes, paths, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize(raw: Column, typos: dict[str, str]) -> Column:
    """Lower case, no-break spaces as spaces, typos mended in order, ` - ` around dashes, single spaces."""
    s = F.lower(F.trim(F.regexp_replace(raw, " ", " ")))
    for bad, good in typos.items():
        s = F.regexp_replace(s, bad, good)
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\s*[-–—]\s*", " - "), r"\s+", " "))


def qualifiers(s: Column) -> Column:
    """The texts inside (...) and [...], and an unbalanced tail after an opening bracket."""
    inner = F.regexp_extract_all(s, F.lit(r"[(\[]([^()\[\]]*)(?:[)\]]|$)"), F.lit(1))
    return F.filter(F.transform(inner, lambda q: F.trim(q)), lambda q: q != "")


def without_qualifiers(s: Column) -> Column:
    bare = F.regexp_replace(s, r"[(\[][^()\[\]]*(?:[)\]]|$)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[)\]]", " "), r"\s+", " "))


def numbers(s: Column) -> Column:
    """Instance numbers of a name: a run such as `1&2&3`, `1, 2 and 3` or `1 2 3`; else a trailing number; else the only one."""
    every = F.transform(F.regexp_extract_all(s, F.lit(r"(?<![0-9])[0-9]{1,9}(?![0-9])"), F.lit(0)), lambda n: n.cast("long"))
    run = F.regexp_extract(s, r"((?<![0-9])[0-9]{1,9}(?:\s*(?:&|,|and|\s)\s*[0-9]{1,9})+)", 1)
    of_run = F.transform(F.regexp_extract_all(run, F.lit("[0-9]+"), F.lit(0)), lambda n: n.cast("long"))
    trailing = F.regexp_extract(s, r"(?:^|[^0-9])([0-9]{1,9})$", 1)
    none = F.array().cast("array<bigint>")
    return F.when(run != "", of_run).when(trailing != "", F.array(trailing.cast("long"))).when(F.size(every) == 1, every).otherwise(none)


def first_rule(rows: DataFrame, key: list[str], candidates: list[str], rules: DataFrame) -> DataFrame:
    """The rule (prio, pattern, label) of smallest (candidate, prio) whose pattern a candidate text matches.

    Rules are a vocabulary: they are folded into one expression over the row, so neither a join nor a shuffle is made.
    """
    table = [(r.prio, r.pattern, r.label) for r in rules.orderBy("prio").collect()]
    label = F.coalesce(*[F.when(F.col(c).rlike(pattern), F.lit(name)) for c in candidates for _, pattern, name in table])
    return rows.withColumn("rule", label)


def resolve_verb(text: Column, cls: Column, pinned: Column, prefixes: dict[str, str], overrides: dict[tuple[str, str], str]) -> Column:
    """The rule's own verb, else that of the first prefix that matches, as the class overrides it."""
    found = F.coalesce(*[F.when(text.rlike(p), F.lit(v)) for p, v in prefixes.items()])
    changed = F.coalesce(*[F.when((cls == c) & (found == v), F.lit(to)) for (c, v), to in overrides.items()], found)
    return F.coalesce(pinned, changed)


def instance_key(*parts: Column, ordinal: Column) -> Column:
    """`class.discriminator.NN`; null parts are left out, ordinals have two digits at least."""
    digits = ordinal.cast("string")
    return F.concat_ws(".", *parts, F.lpad(digits, F.greatest(F.length(digits), F.lit(2)), F.lit("0")))


def edge_digest(rows: DataFrame, by: list[str], line: list[str]) -> DataFrame:
    """First 16 hex digits of the sha256 of the sorted `a|b|...` lines of each key."""
    joined = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in line])
    return rows.groupBy(*by).agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(joined)), "\n"), 256), 1, 16).alias("digest"))


def opaque_id(prefix: str, salt: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", F.lit(salt), *[p.cast("string") for p in parts]), 256), 1, 16))


def image_id(desktop: Column, step: Column, view_index: Column) -> Column:
    return desktop * 100_000 + step * 10 + view_index


def merge_notes(old: Column, line: Column, prefix: str) -> Column:
    """Note lines less those that begin with `prefix`, then the new one-line note; null for none."""
    kept = F.filter(F.split(F.coalesce(old, F.lit("")), "\n"), lambda x: (F.trim(x) != "") & ~x.startswith(prefix))
    new = F.regexp_replace(F.trim(F.coalesce(line, F.lit(""))), r"\s*\n\s*", "; ")
    return F.nullif(F.array_join(F.concat(kept, F.when(new != "", F.array(F.concat(F.lit(prefix + " "), new))).otherwise(F.array().cast("array<string>"))), "\n"), F.lit(""))


def has_note(notes: Column, prefix: str) -> Column:
    """Whether any line begins with `prefix`."""
    return F.exists(F.split(F.coalesce(notes, F.lit("")), "\n"), lambda x: x.startswith(prefix))


def capture_time(token: Column) -> Column:
    """`20250531_104736_629` as a timestamp; anything else is null."""
    ok = token.rlike(r"^[0-9]{8}_[0-9]{6}_[0-9]{3}$")
    return F.when(ok, F.try_to_timestamp(token, F.lit("yyyyMMdd_HHmmss_SSS"))).cast("timestamp_ntz")


def respell(path: Column, old_root: str, new_root: str) -> Column:
    """A path under `old_root` (either kind of slash, any case) under `new_root` with forward slashes; others unchanged."""
    tidy = F.regexp_replace(path, r"\\", "/")
    inside = F.lower(tidy).startswith(old_root.lower().rstrip("/") + "/")
    return F.when(inside, F.concat(F.lit(new_root.rstrip("/")), F.substr(tidy, F.lit(len(old_root.rstrip("/")) + 1)))).otherwise(path)


def wording(key: Column, initialisms: list[str]) -> Column:
    """`cpu_fan` as `CPU fan`: words of a key, initialisms in capitals."""
    word = lambda w: F.when(F.array_contains(F.array(*[F.lit(i) for i in initialisms]), w), F.upper(w)).otherwise(w)
    return F.array_join(F.transform(F.split(key, "_"), word), " ")


def merge_attrs(stored: Column, new: Column, derived: list[str]) -> Column:
    """Map union where stored keys win; derived keys never enter from the new map."""
    extra = F.map_filter(new, lambda k, v: ~F.map_contains_key(stored, k) & ~k.isin(derived))
    return F.map_concat(stored, extra)


def attr_conflicts(stored: Column, new: Column) -> Column:
    """Sorted keys that both maps have with different values."""
    return F.array_sort(F.map_keys(F.map_filter(new, lambda k, v: F.map_contains_key(stored, k) & ~F.element_at(stored, k).eqNullSafe(v))))


def visibility(side: Column, occlusion: Column) -> Column:
    """The label ladder: no geometry, hidden, too small, tiny, partly hidden, visible."""
    return (
        F.when(side.isNull(), "out_of_view").when(occlusion >= 0.95, "occluded_full").when(side < 6, "too_small").when(side < 12, "visible_tiny").when(occlusion >= 0.3, "occluded_partial").otherwise("visible")
    )


def occlusion_ratio(visible: Column, amodal: Column) -> Column:
    return F.when(amodal > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - visible / amodal))).otherwise(0.0)


def desktops(spec: str) -> list[int]:
    """`1-3,13` as numbers."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        a, _, b = part.partition("-")
        out.update(range(int(a), int(b or a) + 1))
    return sorted(out)
