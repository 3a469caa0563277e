"""Libraries of programs: collecting, mining, pruning, covering programs with them, and controls for ablations.

Grouping is by signature or fingerprint with partial aggregation, so frequent ones are combined before the shuffle; a
group's representative comes from ``min_by``, never from a collected list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.plans.programs import MINING_TOKENS, fingerprint, step_signature

#: Most distinct sequences of a library that every row is folded with.
MAX_ENTRIES = 4096


def add_all(programs: DataFrame, order: str = "row_id") -> DataFrame:
    """(fingerprint, support, first_id): programs without repeats; support is how often one came again after the first."""
    fp = programs.where("steps is not null").select(fingerprint(F.col("steps")).alias("fingerprint"), order)
    return fp.groupBy("fingerprint").agg((F.count("*") - 1).alias("support"), F.min(order).alias("first_id"))


def stats(library: DataFrame) -> DataFrame:
    """(size, total_support, avg_support, avg_steps, distinct_programs, diversity, avg_gain) of a library, in one row."""
    n = F.count("*")
    fp = fingerprint(F.col("program.steps"))
    return library.agg(
        n.alias("size"),
        F.coalesce(F.sum("support"), F.lit(0)).alias("total_support"),
        F.round(F.coalesce(F.avg("support"), F.lit(0.0)), 6).alias("avg_support"),
        F.round(F.coalesce(F.avg(F.size("program.steps")), F.lit(0.0)), 6).alias("avg_steps"),
        F.countDistinct(fp).alias("distinct_programs"),
        F.round(F.when(n > 1, F.countDistinct(fp) / n).otherwise(0.0), 6).alias("diversity"),
        F.round(F.coalesce(F.avg("mdl_gain"), F.lit(0.0)), 6).alias("avg_gain"),
    )


def next_id(library: DataFrame) -> DataFrame:
    """(next_id): one more than the largest number of an id of the form L and digits."""
    n = F.when(F.col("sub_id").rlike("^L[0-9]+$"), F.substring("sub_id", 2, 18).cast("bigint"))
    return library.agg((F.coalesce(F.max(n), F.lit(-1)) + 1).alias("next_id"))


def prune(library: DataFrame, min_support: int, min_gain: float) -> DataFrame:
    """Entries with enough support and gain; a null counts as 0."""
    return library.where((F.coalesce("support", F.lit(0)) >= min_support) & (F.coalesce("mdl_gain", F.lit(0.0)) >= min_gain))


def program_steps(programs: DataFrame, key: str = "row_id", steps: str = "steps") -> DataFrame:
    """(key, pos, op, target, expr, inputs, sig): steps in rows, with their signatures; op in lower case."""
    s = programs.select(key, F.posexplode(steps).alias("pos", "s"))
    return s.select(key, F.col("pos").cast("bigint").alias("pos"), F.lower("s.op").alias("op"), "s.target", "s.expr", "s.inputs", step_signature(F.col("s.op"), F.col("s.expr")).alias("sig"))


def signature_of(steps: Column) -> Column:
    """The signatures of all steps by which programs are mined, joined by ';'."""
    return F.array_join(F.transform(steps, lambda s: step_signature(s["op"], s["expr"], MINING_TOKENS)), ";")


def mine_whole(programs: DataFrame, min_support: int = 3, top: int = 64, key: str = "row_id") -> DataFrame:
    """(rank, sig, n_slots, support, main_source, first_id): whole programs by signature and number of slots, the ``top`` most frequent."""
    p = programs.where("steps is not null and size(steps) > 0").select(key, "source", F.coalesce(F.size("slots"), F.lit(0)).cast("bigint").alias("n_slots"), signature_of(F.col("steps")).alias("sig"))
    by_source = p.groupBy("sig", "n_slots", "source").agg(F.count("*").alias("n"), F.min(key).alias("first_id"))
    g = by_source.groupBy("sig", "n_slots").agg(
        F.sum("n").alias("support"),
        F.max_by("source", F.struct(F.when(F.col("source").isNotNull(), F.col("n")).otherwise(0), -F.col("first_id"))).alias("main_source"),
        F.min("first_id").alias("first_id"),
    )
    kept = g.where(F.col("support") >= min_support).orderBy(F.desc("support"), "first_id").limit(top)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("support"), "first_id")).cast("bigint"))  # at most ``top`` rows


def mine_parts(programs: DataFrame, lengths: tuple[int, ...] = (2, 3), min_support: int = 3, key: str = "row_id") -> DataFrame:
    """(part, length, n_inputs, support): runs of steps of longer programs that don't end in an output, by signature and number of free inputs.

    A free input is one that no earlier step of the run makes. Runs with the signature of a whole program are left out.
    """
    s = programs.select(key, F.size("steps").alias("n"), F.posexplode("steps").alias("pos", "s"))
    s = s.select(key, "n", "pos", F.lower("s.op").alias("op"), "s.target", F.coalesce("s.inputs", F.array().cast("array<string>")).alias("inputs"), step_signature(F.col("s.op"), F.col("s.expr"), MINING_TOKENS).alias("sig"))
    w = Window.partitionBy(key).orderBy("pos")
    ahead = s.select("n", *(F.lead(c, i).over(w).alias(f"{c}{i}") for c in ("sig", "op", "target", "inputs") for i in range(max(lengths))))
    parts = None
    for k in lengths:
        free = F.array_distinct(F.concat(*(F.array_except(f"inputs{i}", F.array(*(F.col(f"target{j}") for j in range(i)))) if i else F.col("inputs0") for i in range(k))))
        run = ahead.where(f"n > {k} and op{k - 1} <> 'output'").select(F.concat_ws(";", *(f"sig{i}" for i in range(k))).alias("part"), F.lit(k).cast("bigint").alias("length"), F.size(free).cast("bigint").alias("n_inputs"))
        parts = run if parts is None else parts.unionByName(run)
    whole = programs.where("steps is not null").select(signature_of(F.col("steps")).alias("part")).distinct()
    return parts.groupBy("part", "length", "n_inputs").agg(F.count("*").alias("support")).where(F.col("support") >= min_support).join(whole, "part", "left_anti")


def canonical_step(expr: Column, inputs: Column) -> Column:
    """An expression with its inputs renamed a0, a1, ... in the order of the list, whole words only, all at once.

    Names are replaced by marks first and by their new names then, so a new name is never renamed again.
    """
    marked = F.aggregate(
        F.transform(inputs, lambda n, i: F.struct(n.alias("n"), i.alias("i"))),
        expr,
        lambda e, p: F.regexp_replace(e, F.concat(F.lit(r"\b"), p["n"], F.lit(r"\b")), F.concat(F.lit("\u0001"), p["i"].cast("string"), F.lit("\u0002"))),
    )
    return F.regexp_replace(marked, "\u0001([0-9]+)\u0002", "a$1")


def step_primitives(programs: DataFrame, min_support: int = 3, key: str = "row_id") -> DataFrame:
    """(op, canonical, arity, support): steps other than outputs, with canonical names, by op, expression and number of inputs."""
    s = program_steps(programs, key).where("op <> 'output' and expr is not null")
    inputs = F.filter(F.array_distinct(F.coalesce("inputs", F.array().cast("array<string>"))), lambda n: n.rlike("^[A-Za-z_][A-Za-z_0-9]*$"))
    c = s.select("op", canonical_step(F.col("expr"), inputs).alias("canonical"), F.size(inputs).cast("bigint").alias("arity"))
    return c.groupBy("op", "canonical", "arity").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)


def frequency_top(programs: DataFrame, top: int = 20, key: str = "row_id") -> DataFrame:
    """(fingerprint, n, last_id): the most frequent exact programs, with the last of each."""
    p = programs.where("steps is not null and size(steps) > 0").select(fingerprint(F.col("steps")).alias("fingerprint"), key)
    return p.groupBy("fingerprint").agg(F.count("*").alias("n"), F.max(key).alias("last_id")).orderBy(F.desc("n"), "last_id").limit(top)


def uncompressed(programs: DataFrame, top: int = 16, key: str = "row_id") -> DataFrame:
    """(first_id, n_steps, gap): distinct programs whose number of steps is nearest to the mean, the ``top`` nearest."""
    p = programs.where("steps is not null and size(steps) > 0").select(fingerprint(F.col("steps")).alias("fp"), F.size("steps").cast("bigint").alias("n_steps"), key)
    mean = p.agg(F.avg("n_steps")).first()[0] or 0.0
    d = p.groupBy("fp", "n_steps").agg(F.min(key).alias("first_id"))
    return d.select("first_id", "n_steps", F.round(F.abs(F.col("n_steps") - F.lit(mean)), 6).alias("gap")).orderBy("gap", "first_id").limit(top)


def patterns(calls: DataFrame, success: DataFrame, steps: DataFrame, min_count: int = 3, top: int = 20) -> DataFrame:
    """(gram, n_success, n_failure, success_rate, usage, mdl_gain): the most frequent pairs of adjacent programs.

    calls: (plan_key, pos, sub); success: (plan_key, success), a null counts as failure; steps: (sub, n_steps) of the
    library. usage is the number of plans that hold the pair; gain = (sum of steps - 1) * usage - sum of steps.
    """
    w = Window.partitionBy("plan_key").orderBy("pos")
    g = calls.select("plan_key", F.col("sub").alias("a"), F.lead("sub").over(w).alias("b")).where("a is not null and b is not null").join(success, "plan_key")
    per = g.groupBy("a", "b").agg(F.count_if("success").alias("n_success"), F.count_if(~F.col("success")).alias("n_failure"), F.countDistinct("plan_key").alias("usage"))
    kept = per.where(F.col("n_success") >= min_count).orderBy(F.desc("n_success"), "a", "b").limit(top)
    j = kept.join(steps.select(F.col("sub").alias("a"), F.col("n_steps").alias("na")), "a", "left").join(steps.select(F.col("sub").alias("b"), F.col("n_steps").alias("nb")), "b", "left")
    total = F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0))
    return j.select(
        F.concat("a", F.lit(">"), "b").alias("gram"), "n_success", "n_failure",
        F.round(F.col("n_success") / (F.col("n_success") + F.col("n_failure")), 6).alias("success_rate"), "usage",
        ((total - 1) * F.col("usage") - total).cast("bigint").alias("mdl_gain"),
    )


def greedy_cover(programs: DataFrame, library: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, cover ARRAY<STRING>, covered, n_steps): each program's steps covered from left to right by library entries.

    At each step the entry with most steps whose ops follow there is taken, of equally long ones the first by id, and
    its steps are jumped over; a step that no entry begins at is skipped. The ops of an entry are those of its steps
    without the outputs. The library is small: its distinct op sequences become one array that each row is folded with.
    """
    ops = lambda c: F.transform(F.filter(c, lambda s: F.lower(s["op"]) != "output"), lambda s: F.lower(s["op"]))
    entries = library.where("sub_id is not null").select(F.array_join(ops(F.col("program.steps")), ",").alias("seq"), "sub_id").where("seq <> ''")
    first = entries.groupBy("seq").agg(F.min("sub_id").alias("sub_id"))
    if first.count() > MAX_ENTRIES:
        raise ValueError(f"a library of more than {MAX_ENTRIES} distinct sequences can't be folded with every row")
    known = sorted(((r.seq.split(","), r.sub_id) for r in first.collect()), key=lambda e: (-len(e[0]), e[1]))
    entry = [F.struct(F.lit(len(ops_)).alias("n"), F.lit(i).alias("id"), F.array(*map(F.lit, ops_)).alias("ops")) for ops_, i in known]
    p = programs.where("steps is not null").select(key, ops(F.col("steps")).alias("ops")).withColumn("known", F.array(*entry) if entry else F.expr("CAST(array() AS array<struct<n:int,id:string,ops:array<string>>>)"))
    fold = F.expr(
        "aggregate(if(size(ops) = 0, array(), sequence(0, size(ops) - 1)), named_struct('at', 0, 'cover', CAST(array() AS array<string>), 'n', 0),"
        " (s, i) -> if(i < s.at, s, aggregate(slice(filter(known, e -> slice(ops, i + 1, e.n) = e.ops), 1, 1), named_struct('at', i + 1, 'cover', s.cover, 'n', s.n),"
        " (z, e) -> named_struct('at', i + e.n, 'cover', concat(s.cover, array(e.id)), 'n', s.n + e.n))))"
    )
    return p.select(key, fold.alias("f"), F.size("ops").cast("bigint").alias("n_steps")).select(key, F.array_join("f.cover", ">").alias("cover"), F.col("f.n").cast("bigint").alias("covered"), "n_steps")


def matched_subroutine(programs: DataFrame, library: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, sub_id): the first entry of the library with the same ops, in order; programs without one are left out."""
    seq = lambda c: F.array_join(F.transform(c, lambda s: F.lower(s["op"])), ",")
    first = library.groupBy(seq(F.col("program.steps")).alias("seq")).agg(F.min("sub_id").alias("sub_id"))
    return programs.where("steps is not null").select(key, seq(F.col("steps")).alias("seq")).join(first, "seq").select(key, "sub_id")


def untyped(library: DataFrame) -> DataFrame:
    """A library whose slots are all float."""
    slots = F.transform("program.slots", lambda s: F.struct(s["name"].alias("name"), F.lit("float").alias("dtype"), s["description"].alias("description")))
    return library.withColumn("program", F.col("program").withField("slots", slots))


def shuffled_types(library: DataFrame, seed: int = 42) -> DataFrame:
    """A library with the types of each program's slots in the order of a hash of their places."""
    order = F.array_sort(F.transform("program.slots", lambda s, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), "sub_id", i.cast("string"))).alias("h"), s["dtype"].alias("dtype"))))
    slots = F.zip_with("program.slots", order, lambda s, o: F.struct(s["name"].alias("name"), o["dtype"].alias("dtype"), s["description"].alias("description")))
    return library.withColumn("program", F.col("program").withField("slots", slots))


def random_entries(library: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` entries in the order of a hash."""
    return library.where("sub_id is not null").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "sub_id")), "sub_id").limit(n)
