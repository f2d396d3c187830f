"""Flags of code-fact nodes: sensitive names, barriers, sink sets, enclosing blocks.

All rules read the same flags, so they are computed once per run and written.
Set-valued flags are strings such as ``|print|servlet|``, tested with LIKE.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsight.functions.text import is_test_path, literal_allowed, name_allowed, sensitive_name
from plainsight.operators import reach as R
from plainsight.operators.steps import STEP_COLUMNS, with_step_columns
from plainsight.plans import catalog as C
from plainsight.session import cut_lineage, fixed_table

BROADCAST_ROWS = 200_000


@dataclass
class Facts:
    """Fact tables of one or many projects; columns as in the fixture schemas."""

    nodes: DataFrame
    edges: DataFrame
    types: DataFrame
    rule_sensitive: DataFrame
    rule_sinks: DataFrame


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a written table whose row count is below the bound, else as it is.

    For narrow tables only: a row here is two names and a set of flags.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_CALLEE_WORDS = " OR ".join(f"lower(callee) LIKE '%{w}%'" for w in C.BARRIER_WORDS)
BARRIER_SQL = f"""coalesce(
  (kind IN ('call', 'call_arg') AND ({_CALLEE_WORDS}))
  OR (kind IN ('var_access', 'expr') AND decl_type IN ({_quoted(C.BARRIER_VALUE_TYPES)}))
  OR (kind IN ('call', 'call_arg') AND decl_type IN ({_quoted(C.BARRIER_CALL_TYPES)}))
  OR (kind IN ('assign', 'call_arg') AND name LIKE '%{C.BARRIER_VARIABLE_PART}%'), FALSE)"""


def is_barrier() -> Column:
    """Sanitiser-like calls, crypto and library types, "public" variables."""
    return F.expr(BARRIER_SQL)


def joined_set(values) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.array_sort(values), "|"), F.lit("|"))


def expanded_catalog(closure: DataFrame) -> DataFrame:
    """(decl_type, callee, sinks): catalog rows for the type itself and, where they hold
    for subtypes, for everything below it."""
    spark = closure.sparkSession
    cat = fixed_table(spark, ["sink_set", "root", "below", "callee"],
                      [r for r in C.SINK_CATALOG if r[1] != "*"])
    own = cat.select("sink_set", F.col("root").alias("decl_type"), "callee")
    below = (closure.join(cat.filter("below = 1"), F.col("super_type") == F.col("root"))
             .select("sink_set", F.col("type").alias("decl_type"), "callee"))
    return (own.union(below).groupBy("decl_type", "callee")
            .agg(joined_set(F.collect_set("sink_set")).alias("sinks")))


def any_type_sinks(callee: str = "callee") -> Column:
    """Sets that hold for a callee of any type, without the closing mark."""
    out = F.lit("")
    for name in sorted({r[0] for r in C.SINK_CATALOG if r[1] == "*"}):
        callees = [r[3] for r in C.SINK_CATALOG if r[1] == "*" and r[0] == name]
        out = F.concat(out, F.when(F.col(callee).isin(callees), F.lit(f"|{name}")).otherwise(""))
    return out


TRAITS = [("throwable", "java.lang.Throwable"), ("runtime", "java.lang.RuntimeException"),
          ("servlet_ex", "javax.servlet.ServletException"),
          *[("server_ex", t) for t in C.SERVER_EXCEPTIONS], ("reflect_type", "java.lang.reflect.Type")]


def type_traits(closure: DataFrame) -> DataFrame:
    """(decl_type, traits): what a type is; ``x+`` when it is strictly below x."""
    roots = fixed_table(closure.sparkSession, ["trait", "super_type"], TRAITS)
    below = closure.filter("type <> super_type").join(roots, "super_type").select(
        F.col("type").alias("decl_type"), F.explode(F.array(
            F.col("trait"), F.concat("trait", F.lit("+")))).alias("trait"))
    own = roots.select(F.col("super_type").alias("decl_type"), "trait")
    return (own.unionByName(below).groupBy("decl_type")
            .agg(joined_set(F.collect_set("trait")).alias("traits")))


def block_flags(blocks: DataFrame, traits: DataFrame, form: str = "frontier") -> DataFrame:
    """(parent_id, inside, directly): kinds of all blocks around a statement at any depth, and of the one it stands in."""
    t = blocks.join(traits, "decl_type", "left").withColumn(
        "traits", F.coalesce("traits", F.lit("")))
    catch = F.col("kind") == "catch_block"

    def has(trait):
        return F.col("traits").contains(f"|{trait}|")
    kinds = F.array_compact(F.array(
        F.when(catch, F.lit("catch")),
        F.when(catch & has("throwable") & ~has("runtime") & ~has("servlet_ex"), F.lit("catch:checked")),
        F.when(catch & (F.col("decl_type") == "javax.servlet.ServletException"), F.lit("catch:servlet")),
        F.when(catch & has("runtime"), F.lit("catch:runtime")),
        F.when((F.col("kind") == "then_block") & F.lower("name").contains("debug"), F.lit("then:debug"))))
    own = t.select("id", F.explode(kinds).alias("flag"))
    tree = blocks.select("id", "parent_id")
    up = tree.filter("parent_id IS NOT NULL").select(
        F.col("id").alias("src"), F.col("parent_id").alias("dst"))
    around = R.reach(up, tree.select(F.col("id").alias("node")),
                     own.select(F.col("id").alias("node")), form=form)
    direct = F.when(F.col("source") == F.col("sink"), F.col("flag"))
    return (around.join(own.withColumnRenamed("id", "sink"), "sink")
            .groupBy(F.col("source").alias("parent_id"))
            .agg(joined_set(F.collect_set("flag")).alias("inside"), joined_set(F.collect_set(direct)).alias("directly")))


def _spread_nulls(column: str, ident: str = "id", ways: int = 1024) -> Column:
    """A join key that is never null: rows without a value go to many made-up keys instead of
    one.  These start with a control character, so that they match nothing."""
    made = F.concat(F.lit("\x01"), F.pmod(F.xxhash64(ident), F.lit(ways)).cast("string"))
    return F.coalesce(F.col(column).cast("string"), made)


def _left_join(nodes: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join on nullable columns: most nodes have no callee, name or block."""
    keys = [f"_key_{c}" for c in on]
    left = nodes.withColumns({k: _spread_nulls(c) for k, c in zip(keys, on)})
    renamed = right.select(*[F.col(c).cast("string").alias(k) for k, c in zip(keys, on)],
                           *[c for c in right.columns if c not in on])
    return left.join(renamed, keys, "left").drop(*keys)


def result_sinks(sinks: str) -> Column:
    """Of a set of sinks those that hold for a call or a returned value itself."""
    return F.concat(F.lit("|"), *[F.when(F.col(sinks).contains(f"|{s}|"), F.lit(f"{s}|")).otherwise("") for s in C.RESULT_SETS])


def qualified_sinks(nodes: DataFrame) -> DataFrame:
    """(id, by_qualifier): sets of arguments of calls that are made on the result of a listed call."""
    listed = fixed_table(nodes.sparkSession, ["sink_set", "on_type", "on_callee", "callee"], C.QUALIFIER_SINKS)
    made_on = nodes.filter("kind = 'call'").select(F.col("id").alias("qualifier_id"), F.col("decl_type").alias("on_type"),
                                                   F.col("callee").alias("on_callee"))
    callees = [r[3] for r in C.QUALIFIER_SINKS]
    arguments = nodes.filter((F.col("kind") == "call_arg") & F.col("callee").isin(callees)).select("id", "callee", "qualifier_id")
    return (arguments.join(made_on, "qualifier_id").join(listed, ["on_type", "on_callee", "callee"])
            .groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("sink_set")), "|").alias("by_qualifier")))


def flag_nodes(facts: Facts, closure: DataFrame, with_blocks: bool = True,
               form: str = "frontier") -> DataFrame:
    """Nodes with the columns sensitive, secret_name, barrier, test_path (0/1) and the sets
    sinks, rule_types, traits, inside and directly."""
    traits = cut_lineage(type_traits(closure))
    cat = cut_lineage(expanded_catalog(closure))
    n = with_step_columns(facts.nodes).withColumn("file_name", F.substring_index("path", "/", -1))
    sens = facts.rule_sensitive.select("file_name", "name").distinct().withColumn("_sens", F.lit(1))
    by_rule = facts.rule_sinks.groupBy("file_name", F.col("sink_name").alias("callee")).agg(
        joined_set(F.collect_set("sink_type")).alias("rule_types"))
    n = _left_join(n, broadcast_if_small(traits), ["decl_type"])
    n = _left_join(n, broadcast_if_small(cat), ["decl_type", "callee"])
    # only accesses are looked up by name, only arguments by callee and qualifier: a row is moved for its own kind alone
    accessed, argued = [F.coalesce(F.col("kind") == k, F.lit(False)) for k in ("var_access", "call_arg")]
    arguments = n.filter(argued).join(qualified_sinks(with_step_columns(facts.nodes)), "id", "left")
    n = (_left_join(n.filter(accessed), sens, ["file_name", "name"])
         .unionByName(_left_join(arguments, by_rule, ["file_name", "callee"]), allowMissingColumns=True)
         .unionByName(n.filter(~accessed & ~argued), allowMissingColumns=True))
    if with_blocks:
        blocks = facts.nodes.filter("kind IN ('catch_block', 'then_block')").select(
            "id", "parent_id", "kind", "decl_type", "name")
        n = _left_join(n, block_flags(blocks, traits, form), ["parent_id"])
    else:
        n = n.withColumns({c: F.lit(None).cast("string") for c in ("inside", "directly")})
    argument = F.col("kind") == "call_arg"
    sinks = F.concat(F.when(argument, any_type_sinks()).otherwise(""),
                     F.when((F.col("kind") == "return") & (F.col("decl_type") == C.ANY_RETURN_TYPE),
                            F.lit("|framework|"))
                     .when(argument, F.concat(F.coalesce(F.concat(F.lit("|"), "by_qualifier"), F.lit("")), F.coalesce("sinks", F.lit("|"))))
                     .when(F.col("kind").isin("call", "return"), result_sinks("sinks")).otherwise("|"))
    traits_set = F.coalesce("traits", F.lit(""))
    sensitive = ((F.col("kind") == "var_access") & F.col("_sens").isNotNull()
                 & name_allowed("name") & ~traits_set.contains("|throwable+|"))
    return n.select(
        "id", "path", "file_name", "kind", "name", "callee", "decl_type", "callable_id", "parent_id",
        F.coalesce(sensitive, F.lit(False)).cast("int").alias("sensitive"),
        F.coalesce((F.col("kind") == "var_access") & sensitive_name("name"), F.lit(False))
        .cast("int").alias("secret_name"),
        is_barrier().cast("int").alias("barrier"),
        is_test_path("path").cast("int").alias("test_path"),
        sinks.alias("sinks"),
        F.when(argument, F.coalesce("rule_types", F.lit(""))).otherwise("").alias("rule_types"),
        traits_set.alias("traits"), F.coalesce("inside", F.lit("")).alias("inside"),
        F.coalesce("directly", F.lit("")).alias("directly"), *STEP_COLUMNS)


# --- predicates over the sink relation ---------------------------------------------------

def sink_of_type(calls: DataFrame, rule_sinks: DataFrame, sink_type: str) -> DataFrame:
    """Calls whose name is a sink of this type in their file."""
    wanted = rule_sinks.filter(F.col("sink_type") == sink_type).select(
        "file_name", F.col("sink_name").alias("callee")).distinct()
    return calls.join(wanted, ["file_name", "callee"], "left_semi")


def sink_any(calls: DataFrame, rule_sinks: DataFrame) -> DataFrame:
    """Calls that are sinks of their file, and not log sinks there."""
    named = rule_sinks.select("file_name", F.col("sink_name").alias("callee"), "sink_type")
    logs = named.filter("sink_type = 'Log Sink'").select("file_name", "callee").distinct()
    every = named.select("file_name", "callee").distinct()
    return (calls.join(every, ["file_name", "callee"], "left_semi")
            .join(logs, ["file_name", "callee"], "left_anti"))


def detected_calls(calls: DataFrame, rule_sinks: DataFrame) -> DataFrame:
    every = rule_sinks.select("file_name", F.col("sink_name").alias("callee")).distinct()
    return calls.join(every, ["file_name", "callee"], "left_semi")


def sink_names(calls: DataFrame, rule_sinks: DataFrame) -> DataFrame:
    """Distinct called names that are sinks of a named type in their file."""
    typed = rule_sinks.filter(F.col("sink_type").isin(C.SINK_TYPES))
    return detected_calls(calls, typed).select(F.col("callee").alias("sink_name")).distinct()


def allowed_literals(literals: DataFrame, key_uses: DataFrame, value: str, on: list[str],
                     annotations: DataFrame | None = None) -> DataFrame:
    """Literals that are not sample data, not the key of a getter and not annotation values.

    ``key_uses`` holds the calls, with ``callee`` and the ``on`` columns of their argument.
    """
    keys = key_uses.filter(F.col("callee").isin(C.KEY_GETTERS)).select(*on).distinct()
    out = literals.filter(literal_allowed(value)).join(keys, on, "left_anti")
    if annotations is not None:
        out = out.join(annotations.select(*on).distinct(), on, "left_anti")
    return out


def suppress_if_permission_checked(findings: DataFrame, calls: DataFrame,
                                   callable_col: str = "callable_id") -> DataFrame:
    """Findings out whose callable holds a permission check."""
    like = " OR ".join(f"callee LIKE '{p}'" for p in C.PERMISSION_PATTERNS)
    checked = calls.filter(like).select(F.col("callable_id").alias(callable_col)).distinct()
    return findings.join(checked, callable_col, "left_anti")
