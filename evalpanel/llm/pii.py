"""Personal data by candidate gradient boosting, in DataFrame functions only.

Patterns with checks find the base spans of four kinds. High-recall generators propose further spans of every kind, which may overlap:
obfuscated addresses, runs of numbers with odd separators, telephone and card shapes inside longer runs. Boosted trees, trained
here, score each proposal by its format and context; a threshold per kind, calibrated on held-out spans, selects. The trees are
compiled to CASE expressions, so a document is handled in its own row from text to spans, without a shuffle.

Nobody labels the training spans. Positive are the base spans and rewritings of them (separators changed, signs spelled out);
negative are rewritings that break a check (a wrong check digit, an octet too large, digits missing), the same spans glued to a letter, and proposals that
fail the checks of their kind. The fit and the thresholds use all base spans and all failing proposals of the table, counted by distinct features, and all of these are
candidates for splits; four fifths of the distinct spans train, the rest calibrates. A kind whose thresholds never reach ``precision`` adds nothing, nor does any kind without enough spans of both labels.

Defined results: a null text is empty and has no spans, whose digest is that of the empty string; repeated rows and ids are handled row by row; base
spans of different kinds may overlap; an added span overlaps no base span, and of added spans that overlap each other only the best stays
(higher score, then earlier kind, start and end); an empty table gives no rows; extra columns are kept
by ``personal_data``, except those with the names of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalpanel.llm.common import discard, table, written
from evalpanel.llm.registry import query

KINDS = ("email", "ip", "card", "phone")
#: Spans of the base patterns. Possessive repeats and looks behind give the leftmost greedy matches without backtracking over long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What generators propose, and the kinds that a match is proposed as.
GENERATORS = {
    "mail": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?(?:@|[(\[{]at[)\]}]) ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[{]dot[)\]}]) ?[A-Za-z0-9-]++)*+| at [A-Za-z0-9-]++(?:(?: dot |\.)[A-Za-z0-9-]++)++)", ("email",)),
    "run": (r"[+(]{0,2}[0-9](?:[\x20().\-/]{0,3}+[0-9])++", ("ip", "card", "phone")),
    "tight_card": (r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20.\-/][0-9]{4}){3})(?![0-9])", ("card",)),
    "tight_phone": (r"(?<![0-9])\+?\(?[0-9]{1,4}\)?[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.\-/][0-9]{2,4}){1,3}(?![0-9])", ("phone",)),
}
OCTET = "(?=[0-9])0*+(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])?"
HINTS = {"email": "mail|contact|write|reach", "ip": "ip|host|server|addr|node", "card": "card|visa|master|pay|konto|account", "phone": "tel|phone|call|fax|mobil|cell"}
#: Characters of context on the left that features read.
CONTEXT = 24
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, start: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The running merge of an array: inside chunks, and over the totals of the chunks before; n * CHUNK steps, not n * n."""
    fold = lambda a: F.aggregate(a, start, merge)

    def over(v: Column) -> Column:
        count = F.ceil(F.size(v) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(v, k * CHUNK + 1, F.lit(CHUNK)))

        def joined(c: Column) -> Column:
            return let(
                F.transform(c, fold),
                lambda totals: F.flatten(
                    F.zip_with(
                        c, F.sequence(F.lit(0), F.size(c) - 1), lambda chunk, k: let(fold(F.slice(totals, F.lit(1), k)), lambda before: F.transform(chunk, lambda _, i: merge(before, fold(F.slice(chunk, F.lit(1), i + 1)))))
                    )
                ),
            )

        return F.when(F.size(v) > 0, let(chunks, joined)).otherwise(F.slice(v, 1, 0))

    return let(values, over)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, hit, left, right) for every match, in code points, with a little text on both sides."""
    regex = F.lit(pattern)

    def placed(hits: Column, pieces: Column) -> Column:
        lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.length(p) + F.length(h))
        sides = F.arrays_zip(
            hits.alias("hit"), F.transform(F.slice(pieces, F.lit(1), F.size(hits)), lambda p: F.right(p, F.lit(CONTEXT))).alias("left"), F.transform(F.slice(pieces, F.lit(2), F.size(hits)), lambda p: F.left(p, F.lit(4))).alias("right")
        )
        span = lambda s, end: F.struct((end - F.length(s["hit"])).alias("start"), end.alias("end"), s["hit"], s["left"], s["right"])
        return F.zip_with(sides, running(lengths, F.lit(0), lambda a, b: a + b), span)

    none = F.array().cast("array<struct<start:int,end:int,hit:string,left:string,right:string>>")
    return let(F.regexp_extract_all(text, regex, F.lit(0)), lambda hits: F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), lambda pieces: placed(hits, pieces))).otherwise(none))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether 13 to 19 digits pass the check."""

    def sums(d: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
            return total + F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

        return F.when(F.length(d).between(13, 19), F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))

    return let(number, sums)


def passes(kind: str, s: Column) -> Column:
    """The check that a base match of a kind must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return s.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    return luhn(digits(s)) if kind == "card" else F.length(digits(s)).between(9, 15)


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind; texts without the sign that a kind needs are not searched."""
    needs = {"email": text.contains("@"), "phone": text.contains("+")}
    out = {}
    for kind, pattern in BASE.items():
        given = F.when(needs.get(kind, text.rlike("[0-9]")), text).otherwise("")
        out[kind] = F.filter(matches(given, pattern), lambda m: passes(kind, m["hit"]))
    return out


# ---- proposals and features ----

FEATURES = ("kind", "checks", "digits", "groups", "longest", "length", "plus", "brackets", "dots", "blanks", "dashes", "signs", "labels", "ending", "glued_left", "glued_right", "hint")


def features(kind: Column, hit: Column, left: Column, right: Column) -> Column:
    """Numbers about the format and context of a proposal, as an array in the order of ``FEATURES``."""

    def numbers(s: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r" ?[(\[{]at[)\]}] ?| at | ?@ ?", "@"), r" ?[(\[{]dot[)\]}] ?| dot ", "."), " ", "")

        def of(z: Column) -> Column:
            groups = F.array_remove(F.split(s, "[^0-9]+"), "")
            count = lambda rx: F.length(s) - F.length(F.regexp_replace(s, rx, ""))
            domain = F.element_at(F.split(z, "@"), -1)
            checks = (
                F.when(kind == 0, z.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}$"))
                .when(kind == 1, F.array_join(groups, ".").rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
                .when(kind == 2, luhn(digits(s)))
                .otherwise(F.length(digits(s)).between(9, 15))
            )
            glue = "[A-Za-z0-9_=\"'#&]"
            hint = reduce(lambda c, k: c.when(kind == k, F.lower(left).rlike(HINTS[KINDS[k]])), range(1, 4), F.when(kind == 0, F.lower(left).rlike(HINTS["email"])))
            return F.array(
                *[
                    F.coalesce(x.cast("int"), F.lit(0))
                    for x in (
                        kind, checks, F.length(digits(s)), F.size(groups), F.array_max(F.transform(groups, F.length)), F.length(s), s.startswith("+"), count("[()]"), count(r"\."), count(" "), count("[-/]"),
                        count("[A-Za-z0-9]"), F.size(F.split(domain, r"\.")), F.length(F.regexp_extract(z, r"\.([A-Za-z]*)$", 1)), left.rlike(glue + "$"), right.rlike("^" + glue), hint,
                    )
                ]
            )

        return let(plain, of)

    return let(hit, numbers)


def proposals(text: Column) -> Column:
    """Array of (kind, start, end, x) proposed by the generators; spans that can't be of a kind by their number of digits are not proposed."""
    likely = {"mail": text.contains("@") | F.lower(text).rlike(r"[(\[{ ]at[)\]} ]")}
    sizes = {"ip": (4, 12), "card": (13, 19), "phone": (7, 15)}
    out = []
    for name, (pattern, kinds) in GENERATORS.items():
        found = matches(F.when(likely.get(name, text.rlike("[0-9]")), text).otherwise(""), pattern)

        def each(m: Column) -> Column:
            options = []
            for kind in kinds:
                low, high = sizes.get(kind, (0, 1 << 30))
                k = F.lit(KINDS.index(kind))
                x = F.struct(k.alias("kind"), m["start"].alias("start"), m["end"].alias("end"), features(k, m["hit"], m["left"], m["right"]).alias("x"))
                options.append(F.when(F.length(digits(m["hit"])).between(low, high), x))
            return F.array(*options)

        out.append(F.filter(F.flatten(F.transform(found, each)), lambda p: p.isNotNull()))
    return F.array_distinct(F.concat(*out))


def found_in(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its text replaced by what is found: base spans by kind, and proposals."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*[F.col(c) for c in docs.columns if c not in (text_col, "_base", "_proposed", "_added")], F.struct(*[c.alias(k) for k, c in base_spans(text).items()]).alias("_base"), proposals(text).alias("_proposed"))


# ---- training ----


def rewritten(kind: Column, hit: Column, left: Column) -> Column:
    """Array of (hit, left, label): a base span, rewritings that keep what it is, and rewritings that break it."""
    row = lambda h, label, side=left: F.struct(h.alias("hit"), side.alias("left"), F.lit(float(label)).alias("label"))
    only = digits(hit)
    dotted = F.regexp_replace(only, "([0-9]{4})(?=[0-9])", "$1.")
    broken = F.concat(F.left(only, F.length(only) - 1), ((F.right(only, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    glued = row(hit, 0, F.concat(left, F.lit("x")))
    spelled = lambda at, dot: F.replace(F.replace(hit, F.lit("@"), F.lit(at)), F.lit("."), F.lit(dot))
    mail = [row(hit, 1), row(spelled(" (at) ", "."), 1), row(spelled(" at ", " dot "), 1), row(spelled("[at]", "[dot]"), 1), row(F.regexp_replace(hit, "@.*", "@x1"), 0), row(F.regexp_replace(hit, r".*@([^.]*).*", "so at $1.7"), 0)]
    ip = [row(hit, 1), row(F.replace(hit, F.lit("."), F.lit(" . ")), 1), row(F.concat(hit, F.lit("77")), 0), row(F.concat(hit, F.lit(".7")), 0), glued]
    card = [row(hit, 1), row(dotted, 1), row(broken, 0), row(F.concat(only, F.lit("77")), 0), glued]
    phone = [row(hit, 1), row(F.replace(hit, F.lit("+"), F.lit("")), 1), row(F.replace(hit, F.lit(" "), F.lit(".")), 1), row(F.left(hit, F.lit(7)), 0), row(F.concat(hit, F.lit("-0123456")), 0), glued]
    return F.when(kind == 0, F.array(*mail)).when(kind == 1, F.array(*ip)).when(kind == 2, F.array(*card)).otherwise(F.array(*phone))


def training_rows(found: DataFrame) -> DataFrame:
    """(kind, x, label, held, n): how often each labelled feature row is made, of all base spans and all failing proposals."""
    held = lambda *by: (F.pmod(F.xxhash64(F.lit("held"), *by), F.lit(5)) == 0).alias("held")
    each = F.concat(*[F.transform(F.col(f"_base.{k}"), lambda m: F.struct(F.lit(KINDS.index(k)).alias("kind"), m["hit"].alias("hit"), m["left"].alias("left"), m["right"].alias("right"))) for k in KINDS])
    base = found.select(F.explode(each).alias("s")).select("s.*")
    made = base.select("kind", "right", held("hit"), F.explode(rewritten(F.col("kind"), F.col("hit"), F.col("left"))).alias("r")).select("kind", "right", "held", "r.*")
    made = made.select("kind", features(F.col("kind"), F.col("hit"), F.col("left"), F.col("right")).alias("x"), "label", "held")
    at = {n: i for i, n in enumerate(FEATURES)}
    proposed = found.select(F.explode("_proposed").alias("p")).select("p.kind", "p.x", "p.start", "p.end")
    failing = proposed.filter((F.col("x")[at["checks"]] == 0) | ((F.col("kind") > 0) & (F.col("x")[at["glued_left"]] + F.col("x")[at["glued_right"]] > 0)))
    failing = failing.select("kind", "x", F.lit(0.0).alias("label"), held("start", "end", "x"))
    return made.unionByName(failing).groupBy("kind", "x", "label", "held").agg(F.count("*").alias("n"))


def compiled(model) -> Callable[[Column], Column]:
    """The probability of a fitted ensemble as an expression of the feature array."""

    def tree(node, x: Column) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(x[int(split.featureIndex())] <= F.lit(float(split.threshold())), tree(node.leftChild(), x)).otherwise(tree(node.rightChild(), x))

    roots = [(float(w), t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees)]
    return lambda x: 1 / (1 + F.exp(-2 * reduce(lambda a, b: a + b, [F.lit(w) * tree(root, x) for w, root in roots])))


def bins_for(rows: int) -> int:
    """MLlib looks for splits in a sample of max(bins ** 2, 10,000) rows; with so many bins that is every row."""
    return max(64, math.isqrt(max(rows - 1, 0)) + 1)


def fitted(found: DataFrame, precision: float = 0.99, rounds: int = 12, depth: int = 4, least: int = 20):
    """(score, thresholds): the compiled ensemble and the least accepted probability of each kind, 2 for none; (None, all 2) without enough spans."""
    rows = written(training_rows(found))
    sizes = rows.groupBy("label", "held").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()
    counts = {(r["label"], r["held"]): r["n"] for r in sizes}
    thresholds = [2.0] * len(KINDS)
    if min(counts.get((label, h), 0) for label in (0.0, 1.0) for h in (False, True)) < least:
        discard(rows)
        return None, thresholds
    vectors = rows.filter("NOT held").select(array_to_vector(F.col("x").cast("array<double>")).alias("features"), "label", F.col("n").cast("double").alias("n"))
    bins = bins_for(sum(r["distinct"] for r in sizes if not r["held"]))
    score = compiled(GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=1, maxBins=bins, weightCol="n", checkpointInterval=-1).fit(vectors))
    steps = rows.filter("held").groupBy("kind", F.floor(score(F.col("x")) * 200).alias("step")).agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("good")).collect()
    discard(rows)
    for kind in range(len(KINDS)):
        n = good = 0.0
        for r in sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["step"]):
            n, good = n + r["n"], good + r["good"]
            if n >= least and good >= precision * n:
                thresholds[kind] = r["step"] / 200
    return score, thresholds


# ---- spans ----


def selected(base: Column, proposed: Column, score: Callable[[Column], Column] | None, thresholds: Sequence[float]) -> Column:
    """Array of (kind, start, end, p): the proposals at or above the threshold of their kind that overlap no base span and no better proposal."""
    none = F.array().cast("array<struct<start:int,end:int,kind:int,p:double>>")
    if score is None:
        return none
    scored = F.transform(proposed, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), score(c["x"]).alias("p")))
    good = F.filter(scored, lambda c: reduce(lambda w, k: w.when(c["kind"] == k, c["p"] >= float(thresholds[k])), range(1, len(KINDS)), F.when(c["kind"] == 0, c["p"] >= float(thresholds[0]))))
    marks = F.concat(*[F.transform(base[k], lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(-1).alias("kind"), F.lit(0.0).alias("p"))) for k in KINDS])

    def apart(every: Column) -> Column:
        """Of spans sorted by start, those proposed that reach into no base span before or after."""
        ends = running(F.transform(every, lambda s: F.when(s["kind"] < 0, s["end"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
        far = F.lit((1 << 31) - 1)
        starts = F.reverse(running(F.reverse(F.transform(every, lambda s: F.when(s["kind"] < 0, s["start"]).otherwise(far))), far, lambda a, b: F.least(a, b)))
        return F.filter(F.zip_with(F.zip_with(every, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), starts, lambda a, n: F.when((a["s"]["kind"] >= 0) & (a["e"] <= a["s"]["start"]) & (n >= a["s"]["end"]), a["s"])), lambda s: s.isNotNull())

    def best(some: Column) -> Column:
        better = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"]) & (F.struct(-a["p"], a["kind"], a["start"], a["end"]) < F.struct(-b["p"], b["kind"], b["start"], b["end"]))
        return F.filter(some, lambda b: ~F.exists(some, lambda a: better(a, b)))

    return F.when(F.size(proposed) > 0, let(let(F.array_sort(F.concat(marks, good)), apart), best)).otherwise(none)


def written_out(kind: str, spans: Column) -> Column:
    return F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def personal_data(docs: DataFrame, text_col: str = "text", precision: float = 0.99) -> DataFrame:
    """``docs`` without its text and with _base (spans by kind) and _added (kind, start, end, p)."""
    found = written(found_in(docs, text_col))
    score, thresholds = fitted(found, precision)
    return found.select("*", selected(F.col("_base"), F.col("_proposed"), score, thresholds).alias("_added")).drop("_proposed")


def span_digest(docs: DataFrame, **options) -> DataFrame:
    """Counts of base spans, the digest of their places, and the places of all spans."""
    found = personal_data(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    base = {k: F.transform(F.col(f"_base.{k}"), place) for k in KINDS}
    added = {k: F.transform(F.filter(F.col("_added"), lambda s: s["kind"] == i), place) for i, k in enumerate(KINDS)}
    joined = lambda spans: F.array_join(F.concat(*[written_out(k, spans[k]) for k in KINDS]), ",")
    return found.select(
        "doc_id",
        *[F.size(F.col(f"_base.{k}")).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined({k: F.concat(base[k], added[k]) for k in KINDS}).alias("spans"),
        F.size("_added").cast("long").alias("n_added"),
    )


@query("op11_personal_data")
def op11(spark, sf_dir):
    return span_digest(table(spark, sf_dir, "documents"))
