"""Growing a library from what plans do, plans from programs, control variants for ablations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom.operators.library import canonical_step, program_steps


def varying_slots(calls: DataFrame) -> DataFrame:
    """(sub, slot, n, n_values, varies): for each slot of a program that plans call, whether its inline values differ.

    Slots that vary become parameters of a new program, the others constants. References to calls count as no value.
    """
    r = calls.select("sub", F.explode("refs").alias("slot", "r")).where("r.source in ('quantity', 'constant') and sub is not null")
    per = r.groupBy("sub", "slot").agg(F.count("*").alias("n"), F.countDistinct("r.value").alias("n_values"))
    return per.withColumn("varies", F.col("n_values") > 1)


def shortest_correct(programs: DataFrame, key: str, correct: str, order: str, steps: str = "program.steps") -> DataFrame:
    """(key, order, n_steps): of each key's correct programs the one with fewest steps, of equally short ones the first."""
    n = F.size(steps)
    p = programs.where(F.coalesce(correct, F.lit(False)) & (n > 0) & F.col(key).isNotNull())
    return p.groupBy(key).agg(F.min_by(order, F.struct(n, order)).alias(order), F.min(n).cast("bigint").alias("n_steps"))


def program_plans(programs: DataFrame, primitives: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, plan): programs as plans of step primitives, one call a step, as text 'P1(in, in)>P2(...)'; all steps or none.

    primitives: (op, canonical, arity, prim). A step's inputs that earlier steps make are ``@`` and the number of that
    step; others are the program's slots by name. Programs with a step that no primitive matches are left out.
    """
    s = program_steps(programs, key).where("op <> 'output' and expr is not null")
    inputs = F.filter(F.array_distinct(F.coalesce("inputs", F.array().cast("array<string>"))), lambda n: n.rlike("^[A-Za-z_][A-Za-z_0-9]*$"))
    s = s.select(key, "pos", "target", "op", inputs.alias("ins"), canonical_step(F.col("expr"), inputs).alias("canonical"), F.size(inputs).cast("bigint").alias("arity"))
    m = s.join(primitives, ["op", "canonical", "arity"], "left")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    made = F.collect_list(F.struct("target", "pos")).over(w)
    c = m.withColumn("made", made).withColumn("made", F.expr("if(size(made) > 0, made, CAST(array() AS array<struct<target:string,pos:bigint>>))"))
    c = c.withColumn("shown", F.expr("transform(ins, n -> if(exists(made, m -> m.target = n), concat('@', string(element_at(filter(made, m -> m.target = n), -1).pos)), n))"))
    call = F.concat("prim", F.lit("("), F.array_join("shown", ", "), F.lit(")"))
    return (
        c.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("pos", call.alias("call")))).alias("cs"), F.bool_and(F.col("prim").isNotNull()).alias("whole"))
        .where("whole")
        .select(key, F.array_join(F.transform("cs", lambda x: x["call"]), ">").alias("plan"))
    )


def windowed_entries(programs: DataFrame, lengths: DataFrame, key: str = "row_id", seed: int = 42) -> DataFrame:
    """(sub_id, key, start, n_steps): for each (sub_id, n_steps) of ``lengths`` a run of as many steps of some program, by hash.

    A control of the same size without mining: every program long enough is a candidate, the smallest hash is taken, and
    where the run starts in it is by another hash.
    """
    sizes = programs.where("steps is not null").select(key, F.size("steps").alias("n"))
    longest = lengths.select("sub_id", F.col("n_steps").cast("int").alias("n_steps"))
    rank = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("n_steps").cast("string"), F.col(key).cast("string")))
    wanted = [r.n_steps for r in longest.select("n_steps").distinct().collect()]  # the distinct lengths of a library's programs
    fitting = F.filter(F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<int>"), lambda x: x <= F.col("n"))
    cand = sizes.select(key, "n", F.explode(fitting).alias("n_steps")).select("n_steps", key, "n", rank.alias("h"))
    best = cand.groupBy("n_steps").agg(F.min_by(F.struct(key, "n"), "h").alias("b"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("start"), "sub_id")), 1, 8), 16, 10).cast("bigint")
    start = F.pmod(drawn, F.greatest(F.col("b.n") - F.col("n_steps"), F.lit(0)) + 1)
    return longest.join(best, "n_steps").select("sub_id", f"b.{key}", start.cast("bigint").alias("start"), F.col("n_steps").cast("bigint").alias("n_steps"))


def rebuilt_choice(programs: DataFrame, library: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, sub_id, tier): the entry for a program: the first with the same ops (0), else the first that is not longer (1), else the first (2)."""
    seq = lambda c: F.array_join(F.transform(c, lambda s: F.lower(s["op"])), ",")
    lib = library.where("sub_id is not null").select("sub_id", seq(F.col("program.steps")).alias("seq"), F.size("program.steps").alias("n"))
    same = lib.groupBy("seq").agg(F.min("sub_id").alias("same"))
    shortest = lib.groupBy("n").agg(F.min("sub_id").alias("sub_id")).collect()  # one row per number of steps
    first = min((r.sub_id for r in shortest), default=None)
    fits = F.coalesce(F.array_min(F.array_compact(F.array(*(F.when(F.col("_n") >= r.n, F.lit(r.sub_id)) for r in shortest)))) if shortest else F.lit(None).cast("string"), F.lit(None).cast("string"))
    p = programs.where("steps is not null").select(key, seq(F.col("steps")).alias("seq"), F.size("steps").alias("_n")).join(same, "seq", "left")
    return p.select(key, F.coalesce("same", fits, F.lit(first)).alias("sub_id"), F.when(F.col("same").isNotNull(), 0).when(fits.isNotNull(), 1).otherwise(2).cast("bigint").alias("tier"))


def combined_values(items: DataFrame, key: str, values: str) -> DataFrame:
    """(key, kind, value): the sum, product and difference of a row's first three values: candidates for a missing step."""
    v = F.slice(values, 1, 3)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    product = F.aggregate(v, F.lit(1.0), lambda a, x: a * x)
    difference = F.element_at(v, 1) * 2 - total
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in (("difference", difference), ("product", product), ("sum", total)))))
    return items.where(F.size(values) >= 2).select(key, rows.alias("r")).select(key, "r.kind", "r.value")
