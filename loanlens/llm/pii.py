"""Operator 7: personal data by candidate boosting.

High-recall generators propose overlapping spans for four kinds (email, ip,
card, phone); boosted trees, a model a kind, score each from its format and context; calibrated
thresholds, one a kind, select what is redacted.  Spans that pass the base
rules (pattern and checksum or range) are always kept.

What the trees learn from doesn't repeat the base rules.  Positive are the base
spans and a copy of each in a form that the base patterns don't know
(``name[at]host(dot)tld``, accents, dotted cards, numbers without ``+``), in
the same surroundings.  Negative are candidates that a checksum, a range or
another kind's base span rules out, and a look-alike made from each base span
(a card with a wrong digit, a phone's digits in one run, a version in place of
a host).  Candidates that nothing speaks for or against are only scored.  A
kind's threshold is the lowest score from which at least ``PRECISION`` of a
held-out fifth of the candidates that aren't base spans are positive; ip
has no such form and keeps the base spans alone.

Everything is built from SQL expressions and Spark ML.  Positions come from
splitting a text at a pattern: a match starts after the lengths of all pieces
and matches before it.  The trees are fitted on about ``FIT_ROWS`` candidates
at most; these and the held-out fifth are chosen by a hash of id, place and
match, whatever the files' layout.  Every candidate is scored.

Defined results: a null text counts as empty and has no spans; a table without
candidates, or with candidates of one label only, gets the base spans alone;
repeated rows get a result each; other columns are ignored; offsets are code
points, the end exclusive.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import documents, once, stash

KINDS = ("email", "ip", "card", "phone")

# The base patterns.  A match can only begin where its first run of characters begins, or where the
# last match ended, and no run is ever given back: so written, long runs cost linear time and find the same matches.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The generators: wider than the base, for the trees to choose from.
WIDE = {
    "email": r"(?:(?<![\p{L}\p{N}._%+-])|\G)[\p{L}\p{N}._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)"
             r"[\p{L}\p{N}-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[\p{L}\p{N}-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)++",
    "card": r"[0-9](?:[\x20.-]?[0-9])++",
    "phone": r"[+(0-9][\x20().0-9-]+[0-9]",
}
#: Digits (for email: characters) that a wide match must have.
WIDE_SIZE = {"email": (5, 320), "ip": (4, 16), "card": (12, 19), "phone": (9, 15)}

#: Kinds with trees: those that other forms can be made of.
MADE = ("email", "card", "phone")
FIT_ROWS = 100_000
PRECISION = 0.9
TREES = 10
DEPTH = 4
SPAN = "array<struct<start int, end int, match string, before string, after string>>"


def _running(lengths: Column) -> Column:
    """Sums of the elements before each one, by blocks of 64: linear for all but huge arrays."""
    add = lambda acc, x: acc + x
    block = 64

    def made(x: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")),
                           lambda c: F.aggregate(F.slice(x, c * block + 1, F.lit(block)), F.lit(0), add))
        heads = once(sums, lambda s: F.transform(s, lambda _, c: F.aggregate(F.slice(s, F.lit(1), c), F.lit(0), add)))
        return once(heads, lambda h: F.transform(x, lambda _, i: F.get(h, F.floor(i / block).cast("int")) + F.aggregate(
            F.slice(x, F.floor(i / block).cast("int") * block + 1, F.pmod(i, F.lit(block))), F.lit(0), add)))
    return once(lengths, made)


def spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with their place and surroundings."""
    def made(t: Column) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"), F.split(t, pattern, -1).alias("p"))
        return once(both, placed)

    def placed(z: Column) -> Column:
        # z[i].p is the piece before match i; the last piece has no match
        steps = F.transform(z, lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0)))

        def joined(run: Column) -> Column:
            return F.filter(F.transform(z, lambda x, i: F.struct(
                (F.get(run, i) + F.length(x["p"])).alias("start"),
                (F.get(run, i) + F.length(x["p"]) + F.length(x["m"])).alias("end"),
                x["m"].alias("match"), F.right(x["p"], F.lit(24)).alias("before"),
                F.left(F.coalesce(F.get(z, i + 1)["p"], F.lit("")), F.lit(8)).alias("after"))),
                lambda s: s["match"].isNotNull())
        return once(_running(steps), joined)
    none = F.from_json(F.lit("[]"), SPAN)
    return F.when(F.regexp_like(text, F.lit(pattern)), once(text, made)).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def total(d: Column) -> Column:
        n = F.length(d)

        def step(acc: Column, i: Column) -> Column:
            x = F.substr(d, n - i, F.lit(1)).cast("int")
            return acc + F.when(F.pmod(i, F.lit(2)) == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)
    return F.pmod(once(digits, total), F.lit(10)) == 0


def _valid(kind: str):
    def email(s):
        return F.lit(True)

    def ip(s):
        # leading zeros don't count; up to three digits are left, or the part is too large
        return F.forall(F.split(s["match"], r"\."), lambda x: once(F.regexp_replace(x, "^0+(?=[0-9])", ""), lambda y: F.when(
            F.length(y) > 3, F.lit(False)).otherwise(y.cast("int") <= 255)))

    def card(s):
        return once(_digits(s["match"]), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))

    def phone(s):
        return F.length(_digits(s["match"])).between(9, 15)
    return {"email": email, "ip": ip, "card": card, "phone": phone}[kind]


def _wide_enough(kind: str):
    low, high = WIDE_SIZE[kind]

    def test(s):
        size = F.length(s["match"]) if kind == "email" else F.length(_digits(s["match"]))
        return size.between(low, high)
    return test


def _tagged(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end"), s["match"].alias("match"),
        s["before"].alias("before"), s["after"].alias("after")))


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: ``row, doc_id, base, cand`` (arrays of spans in order of start and kind)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    some = F.regexp_like(F.col("_text"), F.lit(r"[0-9@]|[\[(]at[\])]"))
    base = F.concat(*[_tagged(F.filter(spans(F.col("_text"), BASE[k]), _valid(k)), k) for k in KINDS])
    cand = F.concat(*[_tagged(F.filter(spans(F.col("_text"), WIDE[k]), _wide_enough(k)), k) for k in KINDS])
    none = F.filter(_tagged(F.from_json(F.lit("[]"), SPAN), "email"), lambda _: F.lit(False))
    return df.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                     F.when(some, F.array_sort(base)).otherwise(none).alias("base"),
                     F.when(some, F.array_sort(cand)).otherwise(none).alias("cand"))


def _features() -> dict[str, Column]:
    m, before, after = F.col("match"), F.col("before"), F.col("after")
    count = lambda pattern: F.regexp_count(m, F.lit(pattern)).cast("double")
    like = lambda c, pattern: flag(F.regexp_like(c, F.lit(pattern)))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        # of features that part the fitted rows equally well the first one is taken: form comes before counts
        "ending": F.length(F.regexp_extract(m, r"[.\])\x20]([A-Za-z]+)$", 1)).cast("double"), "checksum": flag(_valid("card")(F.struct(m.alias("match")))),
        "fours": like(m, r"^[0-9]{4}([\x20.-]?[0-9]{4}){2,3}$"), "dotted": like(m, r"^[0-9]+(\.[0-9]+)+$"),
        "plus": like(m, r"^\+"), "zeros": like(m, "^00"), "groups": count("[0-9]+"), "brackets": count(r"[()\[\]]"),
        "dots": count(r"\."), "dashes": count("-"), "spaces": count(" "), "letters": count(r"\p{L}"), "accents": count(r"[^\x00-\x7F]"),
        "digits": count("[0-9]"), "length": F.length(m).cast("double"),
        "glued_before": like(before, r"[\p{L}0-9_]$"), "glued_after": like(after, r"^[\p{L}0-9_]"),
        "sign_before": like(before, r"[=\"'#$:/.+-]$"), "sign_after": like(after, r"^[=\"'/@.+-]"),
        "named": like(F.lower(before), r"(tel|phone|call|mail|card|visa|ip|host|contact)\W*$"),
        "secret": like(F.lower(before), r"(token|key|secret|hash|id|version|v)\W*$"),
    }


def _made(kind: str, m: Column, draw: Column) -> tuple[Column, Column]:
    """A base span in a form that the base patterns don't know, and something that only looks alike."""
    digits = _digits(m)
    form = F.pmod(draw, F.lit(3))
    if kind == "email":
        name, host = F.regexp_extract(m, "^(.*)@", 1), F.regexp_extract(m, "@(.*)$", 1)
        # digits in the name, or not, so that their number alone tells nothing
        own = F.concat(name, F.when(F.pmod(F.floor(draw / 3), F.lit(2)) == 0, F.pmod(draw, F.lit(1000)).cast("string")).otherwise(""))
        good = F.when(form == 0, F.concat(own, F.lit("[at]"), host)).when(form == 1, F.concat(
            own, F.lit(" (at) "), F.regexp_replace(host, r"\.", " (dot) "))).otherwise(F.concat(own, F.lit("é@"), host))
        return good, F.concat(name, F.lit("é@"), F.pmod(draw, F.lit(19)), F.lit("."), F.pmod(draw, F.lit(7)), F.lit(".0"))
    if kind == "card":
        wrong = F.concat(F.left(digits, F.length(digits) - 1), F.pmod(F.right(digits, F.lit(1)).cast("int") + 1 + form, F.lit(10)))
        return tuple(F.regexp_replace(d, "([0-9]{4})(?=[0-9])", "$1.") for d in (digits, wrong))
    # phone
    ten = lambda to: F.regexp_replace(F.right(digits, F.lit(10)), "([0-9]{3})([0-9]{3})([0-9]{4})", to)
    good = F.when((form == 2) | (F.length(digits) < 10), F.regexp_replace(m, r"^\+", "00")).when(
        form == 0, ten("($1) $2-$3")).otherwise(ten("$1-$2-$3"))
    return good, digits


def labelled(found: DataFrame) -> DataFrame:
    """All candidates of ``propose`` (``row, k, start, end, match, before, after, exact, clash, draw``) with ``label``: 1.0, 0.0 or NULL
    where nothing speaks for or against; and, without a row, the spans made of base spans."""
    one = found.select("row", "doc_id", "base", F.explode("cand").alias("s")).select("row", "doc_id", "base", "s.*")
    test = lambda text: F.expr(f"exists(base, b -> {text})")
    own = "b.k = k AND b.start >= start AND b.end <= end"
    exact = test("b.k = k AND b.start = start AND b.end = end")
    # a candidate may widen a base address, but not cut through or repeat a base span
    same = exact | ((F.col("k") == 0) & test(own))
    clash = test("b.start < end AND b.end > start") & ~same
    card, phone = KINDS.index("card"), KINDS.index("phone")
    label = (F.when(same, 1.0).when(clash | (F.col("k") == KINDS.index("ip")), 0.0)
             .when((F.col("k") == card) & ~_valid("card")(F.struct("match")), 0.0)
             .when((F.col("k") == phone) & F.regexp_like("match", F.lit(r"^[0-9]+(\.[0-9]+)+$")), 0.0))
    one = one.select("row", "k", "start", "end", "match", "before", "after", label.alias("label"), exact.alias("exact"), clash.alias("clash"),
                     F.pmod(F.xxhash64("doc_id", "start", "match"), F.lit(1_000_000)).alias("draw"))
    out = one
    for kind in MADE:
        spans_ = F.array(*[F.struct(m.alias("m"), F.lit(y).alias("y")) for m, y in zip(
            _made(kind, F.col("match"), F.col("draw")), (1.0, 0.0), strict=True)])
        made = one.filter(F.col("exact") & (F.col("k") == KINDS.index(kind))).withColumn("x", F.explode(spans_))
        out = out.unionByName(made.select(
            F.lit(None).cast("long").alias("row"), "k", "start", "end", F.col("x.m").alias("match"), "before", "after",
            F.col("x.y").alias("label"), F.lit(False).alias("exact"), F.lit(False).alias("clash"), "draw"))
    return out


def score_candidates(found: DataFrame, fit_rows: int = FIT_ROWS, precision: float = PRECISION) -> DataFrame:
    """``row, k, start, end`` of the candidates that the trees select beside the base spans."""
    feats = _features()
    one = stash(labelled(found).select("row", "k", "start", "end", "label", "exact", "clash", "draw",
                                       *[v.alias(f"f_{n}") for n, v in feats.items()]))
    rows = VectorAssembler(inputCols=[f"f_{n}" for n in feats], outputCol="features").transform(one)
    fold = F.pmod(F.col("draw"), F.lit(5))
    counted = one.filter("label IS NOT NULL").groupBy("k", "label").agg(F.count(F.lit(1)).alias("n")).collect()      # two rows a kind
    out = one.select("row", "k", "start", "end").limit(0)
    for k in map(KINDS.index, MADE):
        share = min(1.0, fit_rows / len(MADE) / max(1, sum(r["n"] for r in counted if r["k"] == k)))
        mine = rows.filter(F.col("k") == k)
        fit = mine.filter(F.col("label").isNotNull() & (F.col("draw") < share * 1_000_000) & (fold != 0))
        fit = fit.select("features", "label", "draw", "start").repartition(4, "draw").sortWithinPartitions("draw", "start", "label")
        if fit.agg(F.count_distinct("label")).first()[0] < 2:
            continue
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxMemoryInMB=64).fit(fit.select("features", "label"))
        scored = model.transform(mine).withColumn("step", F.floor(vector_to_array("probability")[1] * 100))
        # at most 101 steps
        bins = scored.filter((fold == 0) & F.col("label").isNotNull() & ~F.col("exact")).groupBy("step").agg(
            F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).collect()
        n = good = 0.0
        cut = None
        for r in sorted(bins, key=lambda r: -r["step"]):
            n, good = n + r["n"], good + r["good"]
            if good >= precision * n:
                cut = r["step"]
        if cut is not None:
            out = out.unionByName(scored.filter(F.col("row").isNotNull() & (F.col("step") >= cut) & ~F.col("exact") & ~F.col("clash"))
                                  .select("row", "k", "start", "end"))
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       fit_rows: int = FIT_ROWS, precision: float = PRECISION) -> DataFrame:
    """``doc_id, base, spans``: arrays of ``{start, k, end}`` (``k``: place in ``KINDS``), a row for each document."""
    found = stash(propose(docs, id_col, text_col))
    place = lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"))
    # selected candidates of one document
    more = score_candidates(found, fit_rows, precision).groupBy("row").agg(
        F.collect_set(F.struct("start", "k", "end")).alias("_more"))
    out = found.select("row", "doc_id", F.transform("base", place).alias("base")).join(more, "row", "left")
    return out.select("doc_id", "base", F.array_sort(F.when(F.col("_more").isNull(), F.col("base")).otherwise(
        F.concat("base", "_more"))).alias("spans"))


def _joined(spans_: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir))

    def number(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["k"] == i)).cast("long")
    return found.select("doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
