"""Plans, typed and as text, as flat tables of calls, bindings and finals that know what they refer to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.operators.nested import json_variant, relationalize, relationalize_declared, reparsed, united
from planloom.plans.schemas import PLAN
from planloom.session import cut

#: Fields that may wrap a plan in a larger record.
WRAPPERS = ("plan", "plan_data")
#: The position that a plan's final has among its calls: after all of them.
AFTER_ALL = 2**62


def plan_variant(text: Column) -> Column:
    """The plan in a text; NULL if there is no complete one."""
    return plan_of(json_variant(text))


def plan_of(v: Column) -> Column:
    """The object with calls that a VARIANT is, or has in any of ``WRAPPERS``; NULL if there is none."""
    field = lambda name: reparsed(F.try_variant_get(v, f"$.{name}", "variant"))
    has_calls = lambda x: F.try_variant_get(x, "$.calls", "variant").isNotNull()
    found = F.when(has_calls(v), v)
    for name in WRAPPERS:
        found = F.coalesce(found, F.when(has_calls(field(name)), field(name)))
    return found


@dataclass(frozen=True)
class PlanDocuments:
    """Plans, one row each: typed (plan_key, plan STRUCT) and of texts (plan_key, plan VARIANT)."""

    typed: DataFrame | None
    raw: DataFrame | None


def plan_documents(typed: DataFrame | None = None, raw: DataFrame | None = None) -> PlanDocuments:
    """The plans of typed rows (plan_key, calls, final) and of texts (plan_key, plan_data).

    Rows delivered again count once: of a text's deliveries a complete one is taken. Rows with a null key are left out;
    texts without a complete plan too. The two tables share no keys.
    """
    if typed is not None:
        plan = F.first(F.struct(F.col("calls").cast(PLAN["calls"].dataType).alias("calls"), F.col("final").cast(PLAN["final"].dataType).alias("final")))
        typed = typed.where("plan_key is not null").groupBy("plan_key").agg(plan.alias("plan"))
    if raw is not None:
        # parsed once a row, then looked into
        parsed = raw.where("plan_key is not null").select("plan_key", "plan_data", F.explode(F.array(json_variant(F.col("plan_data")))).alias("v"))
        complete = parsed.select("plan_key", "plan_data", plan_of(F.col("v")).alias("plan")).where("plan is not null")
        raw = complete.groupBy("plan_key").agg(F.min_by("plan", "plan_data").alias("plan"))
    return PlanDocuments(typed, raw)


def plan_tables(documents: PlanDocuments, narrow: bool = False) -> dict[str, DataFrame]:
    """``calls``, ``bindings`` and ``finals`` of plans, by ``relationalize`` and for typed ones ``relationalize_declared``; see there for keys and ordinals.

    Each binding and final has ``ref_pos``: of a reference to a call's output the position of the call meant, else -1.
    With ``narrow`` only the columns of ``plan_nodes`` are made, and kept, as each is read more than once.
    Call ids may be missing or repeated; meant is the last such call before the binding's own, for a final the last.
    """
    keys = {"bindings": "slot"}
    parts = []
    if documents.typed is not None:
        parts.append(relationalize_declared(cut(documents.typed), "plan_key", "plan", key_fields=keys))
    if documents.raw is not None:
        parts.append(relationalize(cut(documents.raw), "plan_key", "plan", like=PLAN, key_fields=keys))
    flat = united(*parts)
    calls = flat["calls"].select("plan_key", F.col("calls_pos").alias("call_pos"), "node_id", "parent_id", "call_id", F.trim(F.upper("sub_id")).alias("sub_id"))
    bindings = (
        flat["calls.bindings"]
        .where("bindings_key is not null")
        .select(
            "plan_key",
            F.col("calls_pos").alias("call_pos"),
            F.col("bindings_key").alias("slot"),
            F.col("bindings_pos").alias("slot_pos"),
            "node_id",
            "parent_id",
            "source",
            F.col("call_id").alias("ref_call_id"),
            F.coalesce("value", F.expr("try_cast(scalar AS double)")).alias("value"),
        )
    )
    finals = (
        flat["root"]
        .where("final_present")
        .select(
            "plan_key",
            F.lit(-1).cast("bigint").alias("call_pos"),
            F.lit("").alias("slot"),
            F.lit(0).cast("bigint").alias("slot_pos"),
            F.concat_ws("/", "node_id", F.lit("final")).alias("node_id"),
            F.col("node_id").alias("parent_id"),
            F.col("final_source").alias("source"),
            F.col("final_call_id").alias("ref_call_id"),
            F.col("final_value").alias("value"),
        )
    )
    refs = bindings.unionByName(finals)
    if narrow:
        calls, refs = cut(calls.select("plan_key", "call_pos", "call_id")), cut(refs.select("plan_key", "call_pos", "slot", "source", "ref_call_id"))
    linked = resolve_links(calls, refs)
    return {"calls": calls, "bindings": linked.where("call_pos >= 0"), "finals": linked.where("call_pos < 0"), "refs": linked}


def resolve_links(calls: DataFrame, refs: DataFrame) -> DataFrame:
    """``refs`` with ``ref_pos``, by one sort of calls and references to calls; other rows aren't shuffled."""
    pointing = (F.col("source") == "call_output") & F.col("ref_call_id").isNotNull()
    at = F.when(F.col("call_pos") < 0, F.lit(AFTER_ALL)).otherwise(F.col("call_pos"))
    inner = refs.where(pointing).withColumns({"_at": at, "_call": F.lit(None).cast("bigint")})
    targets = calls.where("call_id is not null").select(
        "plan_key", F.col("call_id").alias("ref_call_id"), F.col("call_pos").alias("_at"), F.col("call_pos").alias("_call")
    )
    w = Window.partitionBy("plan_key", "ref_call_id").orderBy("_at", F.col("_call").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    found = (
        inner.unionByName(targets, allowMissingColumns=True)
        .withColumn("ref_pos", F.coalesce(F.last("_call", ignorenulls=True).over(w), F.lit(-1).cast("bigint")))
        .where("_call is null")
        .drop("_at", "_call")
    )
    return found.unionByName(refs.where(~F.coalesce(pointing, F.lit(False))).withColumn("ref_pos", F.lit(-1).cast("bigint")))


def plan_nodes(typed: DataFrame, raw: DataFrame) -> DataFrame:
    """Every call, binding and final of every plan: (plan_key, node_kind, call_pos, slot, ref_pos)."""
    t = plan_tables(plan_documents(typed, raw), narrow=True)
    none = F.lit(-1).cast("bigint")
    calls = t["calls"].select("plan_key", F.lit("call").alias("node_kind"), "call_pos", F.lit("").alias("slot"), none.alias("ref_pos"))
    refs = t["refs"].select("plan_key", F.when(F.col("call_pos") < 0, "final").otherwise("binding").alias("node_kind"), "call_pos", "slot", "ref_pos")
    return calls.unionByName(refs)


def plan_links(documents: PlanDocuments) -> DataFrame:
    """(plan_key, node_kind, node_id, parent_id, call_pos, slot_pos, slot): every node with its surrogate key, its parent's and the ordinals on the way.

    The parent of a binding is its call, that of a call and of a final its plan; slot_pos and call_pos are -1 where a
    node has none, slot is ''.
    """
    t = plan_tables(documents)
    none = F.lit(-1).cast("bigint")
    calls = t["calls"].select("plan_key", F.lit("call").alias("node_kind"), "node_id", "parent_id", "call_pos", none.alias("slot_pos"), F.lit("").alias("slot"))
    is_final = F.col("call_pos") < 0
    refs = t["refs"].select("plan_key", F.when(is_final, "final").otherwise("binding").alias("node_kind"), "node_id", "parent_id", "call_pos", F.when(is_final, none).otherwise(F.col("slot_pos")).alias("slot_pos"), "slot")
    return calls.unionByName(refs)
