"""From raw response text to a value and a score.

Almost every response is one flat JSON object, possibly fenced, and stays on the JVM. The rest goes to
a small decoder in Arrow batches; rows already solved are sent as NULL.
"""

from __future__ import annotations

import json
import re
from typing import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalpanel.functions.levels import spread

# Accepted names of the value, in order of preference, the score's name, and the fence.
VALUE_KEYS = ("vegetation_percent", "vegetation_cover")
SCORE_KEY = "confidence"
FENCE = r"^```(?:json)?\s*|\s*```$"

# Outcome labels of a response row.
OK, PARSE_FAILURE, INFERENCE_FAILURE = "", "JSON_PARSE_FAILURE", "INFERENCE_FAILURE"

# Text, as a NaN among doubles would come back as NULL.
_PAIR = T.StructType([T.StructField("value", T.StringType()), T.StructField("score", T.StringType())])

# One flat object in strict JSON with numbers that any parser reads alike; all else goes to the decoder.
_STRING = r'"[^"\\\x00-\x1f]*"'
_NUMBER = r"-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]{1,17})?(?:[eE][+-]?[0-9]{1,2})?"
_ITEM = rf"[ \t\r\n]*{_STRING}[ \t\r\n]*:[ \t\r\n]*(?:{_NUMBER}|{_STRING}|true|false|null)[ \t\r\n]*"
PLAIN = rf"^\{{{_ITEM}(?:,{_ITEM})*\}}$"


def _as_pair(found) -> tuple[float, float] | None:
    if not isinstance(found, dict):
        return None
    present = [k for k in VALUE_KEYS if k in found]
    pair = (found[present[0]] if present else None, found.get(SCORE_KEY))
    if any(type(v) not in (int, float) for v in pair):
        return None
    try:
        return float(pair[0]), float(pair[1])
    except OverflowError:  # an integer beyond the range of doubles is no answer
        return None


def decode(text: str | None) -> tuple[float, float] | None:
    """The whole text if it is a qualifying object, else the object starting last that qualifies."""
    if text is None:
        return None
    whole = re.sub(FENCE, "", text.strip(), flags=re.MULTILINE).strip()
    try:
        pair = _as_pair(json.loads(whole))
    except (ValueError, RecursionError):
        pair = None
    decoder = json.JSONDecoder()
    at = text.rfind("{")
    while pair is None and at >= 0:
        try:
            pair = _as_pair(decoder.raw_decode(text, at)[0])
        except (ValueError, RecursionError):
            pass
        at = text.rfind("{", 0, at)
    return pair


@F.pandas_udf(_PAIR)
def _decode_batch(found: pd.DataFrame) -> pd.DataFrame:
    """The pairs found so far, and those of the texts that are left."""
    solved = zip(found["value"].tolist(), found["score"].tolist(), found["text"].tolist())
    pairs = [decode(t) if t is not None else (v, s) if v == v and v is not None else None for v, s, t in solved]
    return pd.DataFrame({"value": [p and repr(p[0]) for p in pairs], "score": [p and repr(p[1]) for p in pairs]}, dtype="object")


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_response(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add ``value`` and ``score``; both NULL when the response holds no answer.

    Parsing costs far more than reading, and a compressed file is few scan tasks, so the rows are spread over all shuffle partitions first.
    """
    df = spread(df)
    fields = T.StructType([T.StructField(k, T.DoubleType()) for k in (*VALUE_KEYS, SCORE_KEY)])
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

    def answer(j: Column) -> Column:
        sound = j["keys"].isNotNull() & (F.size(F.array_distinct(j["keys"])) == F.size(j["keys"]))
        value = F.lit(None).cast("double")
        for k in reversed(VALUE_KEYS):
            value = F.when(F.array_contains(j["keys"], F.lit(k)), j["flat"][k]).otherwise(value)
        return F.struct(value.alias("value"), j["flat"][SCORE_KEY].alias("score"), sound.alias("sound"))

    def known(f: Column) -> Column:
        fast = F.coalesce(f["sound"], F.lit(False)) & f["value"].isNotNull() & f["score"].isNotNull()
        return F.struct(F.when(fast, f["value"]).alias("value"), F.when(fast, f["score"]).alias("score"), F.when(~fast, F.col(text)).alias("text"))

    parsed = lambda b: F.struct(F.from_json(b, fields, strict).alias("flat"), F.json_object_keys(b).alias("keys"))
    body = F.trim(F.regexp_replace(F.trim(F.col(text)), "(?m)" + FENCE, ""))
    plain = _once(body, lambda b: F.when(b.rlike(PLAIN), b))
    found = _once(_once(_once(plain, parsed), answer), known)
    slow = df.withColumn("_d", _decode_batch(found))
    return slow.withColumns({"value": F.col("_d.value").cast("double"), "score": F.col("_d.score").cast("double")}).drop("_d")


def with_outcome(parsed: DataFrame, text: str = "raw_text", error: str | None = None) -> DataFrame:
    """Outcome label: inference failed (no text, or a logged error), text without answer, or fine."""
    failed = F.col(text).isNull()
    if error is not None:
        failed = failed | (F.coalesce(F.col(error), F.lit("")) != "")
    out = F.when(failed, INFERENCE_FAILURE).when(F.col("value").isNull(), PARSE_FAILURE).otherwise(OK)
    return parsed.withColumn("outcome", out)


def outcome_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("outcome") == OK).alias("n_ok"),
        F.count_if(F.col("outcome") == PARSE_FAILURE).alias("n_parse_failure"),
        F.count_if(F.col("outcome") == INFERENCE_FAILURE).alias("n_inference_failure"),
    )


def finished(log: DataFrame, key: Sequence[str], outcome: str = "outcome") -> DataFrame:
    """Keys that need no further attempt: an answer, or a text that could not be parsed."""
    return log.filter(F.coalesce(F.col(outcome), F.lit("")).isin(OK, PARSE_FAILURE)).select(*key).distinct()


def pending(units: DataFrame, axes: dict[str, Sequence[str]], log: DataFrame, unit: str = "unit", outcome: str = "outcome") -> DataFrame:
    """The grid of units x declared axis values minus what is finished."""
    grid = units.select(unit)
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    key = [unit, *axes]
    return grid.join(finished(log, key, outcome), key, "left_anti")


def is_complete(units: DataFrame, axes: dict[str, Sequence[str]], log: DataFrame, unit: str = "unit", outcome: str = "outcome") -> DataFrame:
    return pending(units, axes, log, unit, outcome).agg(
        F.count("*").alias("n_pending"), (F.count("*") == 0).alias("complete")
    )


def merge_successes(previous: DataFrame, new: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Earlier successes together with all new rows."""
    return previous.filter(F.col(outcome) == OK).unionByName(new, allowMissingColumns=True)


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key in a stated order; an aggregate, so a hot key is combined map-side."""
    rest = [c for c in df.columns if c not in key]
    chosen = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(chosen.alias("_f")).select(*key, *[F.col(f"_f.{c}").alias(c) for c in rest])


def latency_summary(df: DataFrame, keys: Sequence[str], latency: str = "latency_ms", exact: bool = True) -> DataFrame:
    """Mean and quantiles of a run field; ``exact=False`` uses a sketch for very long logs."""
    from evalpanel.functions.levels import join_null_safe, quantiles

    base = df.groupBy(*keys).agg(F.count(latency).alias("n"), F.avg(latency).alias("mean"), F.max(latency).alias("max"))
    if exact:
        q = quantiles(df, keys, latency, {"p50": 0.5, "p95": 0.95}, 100.0)
    else:
        q = df.groupBy(*keys).agg(F.percentile_approx(latency, [0.5, 0.95], 10_000).alias("_q")).select(
            *keys, F.col("_q")[0].alias("p50"), F.col("_q")[1].alias("p95")
        )
    return join_null_safe(base, q, keys)
