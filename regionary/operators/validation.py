"""The rule engine: pair rules to issues, issues to counts by severity, counts to a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.reading import address_drift

#: The severity of each code.
SEVERITY = {
    "TRANSLATION_IDENTICAL": "P1",
    "TRANSLATION_TRUNCATED": "P1",
    "TARGET_LANG_SUSPECT": "P1",
    "LLM_ARTIFACT": "P1",
    "NUMBER_DRIFT": "P1",
    "NEGATION_DROP": "P1",
    "SYMBOL_DRIFT": "P1",
    "TRANSLATION_CARRY_THROUGH": "P0",
    "CONSISTENCY_ENTITY": "P1",
}


def pair_rules(source: Column, target: Column, keep: tuple[str, ...] = (), target_language: str = "") -> dict[str, Column]:
    """Independent rules over a pair; null means no verdict."""
    kind = T.authenticity(source, target, keep, target_language)
    bag = lambda c: F.array_sort(T.digit_runs(c))
    return {
        "TRANSLATION_IDENTICAL": kind == "identical",
        "TRANSLATION_TRUNCATED": kind == "truncated",
        "TARGET_LANG_SUSPECT": kind == "lang_suspect",
        "LLM_ARTIFACT": T.artifact(source, target).isNotNull(),
        "NUMBER_DRIFT": bag(source) != bag(target),
        "NEGATION_DROP": T.negation_drop(source, target),
        "SYMBOL_DRIFT": T.symbol_drift(source, target) > 0,
        "TRANSLATION_CARRY_THROUGH": T.carry_through(source, target),
        "CONSISTENCY_ENTITY": F.size(address_drift(source, target)) > 0,
    }


def issues(df: DataFrame, ids: list[str], rules: dict[str, Column]) -> DataFrame:
    """SC23 and RG7: one row per rule that fires, from one pass over the rows."""
    fired = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"))) for code, rule in rules.items()]))
    return df.select(*ids, F.explode(fired).alias("i")).select(*ids, "i.code", "i.severity")


def severity_counts(found: DataFrame, per: list[str]) -> DataFrame:
    """AG15."""
    return found.groupBy(*per).agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("P0", "P1", "P2")])


def verdict(counts: DataFrame, partial: Column | None = None) -> DataFrame:
    """GT8: passes just if nothing of P0 or P1 is open and the run is whole."""
    ok = (F.col("p0") == 0) & (F.col("p1") == 0) & ~(partial if partial is not None else F.lit(False))
    return counts.withColumn("result", F.when(ok, "AUTO_QA_PASS").otherwise("NEEDS_REVIEW"))


def unwaived(found: DataFrame, waivers: DataFrame, per: list[str]) -> DataFrame:
    """GT9: what bars a release: every P0, and the P1 codes that no waiver names."""
    return found.filter("severity = 'P0'").unionByName(found.filter("severity = 'P1'").join(waivers.select(*per, "code"), [*per, "code"], "left_anti").select(*found.columns))


def ratio_gate(df: DataFrame, per: list[str], flags: dict[str, Column], most: float = 0.05) -> DataFrame:
    """AG16: the share of each flag and whether it is within ``most``."""
    shares = df.groupBy(*per).agg(*[F.avg(F.coalesce(f, F.lit(False)).cast("int")).alias(n) for n, f in flags.items()])
    return shares.withColumn("passed", F.greatest(*[F.col(n) for n in flags], F.lit(0.0)) <= most)
