"""The rule pack as data, and the one job that runs it.

A rule names its sources, sinks and extras as predicates over flagged nodes
(``operators.facts.flag_nodes``); adding a rule means adding a row here.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsight.functions.text import has_query_param
from plainsight.operators import reach as R
from plainsight.operators.facts import Facts, flag_nodes, joined_set
from plainsight.operators.steps import StepRule, catch_uses, derived_steps, exception_steps
from plainsight.plans import catalog as C
from plainsight.session import written


@dataclass(frozen=True)
class Rule:
    rule_id: str
    message: str
    source: str
    sink: str
    barriers: bool = True
    barrier_in: bool = False
    skip_tests: bool = True
    local: bool = False
    # (state before, state after, predicate on the node entered); a fourth entry names the kinds of derived steps
    steps: tuple[tuple, ...] = ()
    # nodes that stop this rule's flow beside the barriers
    extra_barriers: str | None = None
    # sources (or sinks) in the first predicate must be reached from the second
    source_needs: tuple[str, str] | None = None
    sink_needs: tuple[str, str] | None = None
    # findings out whose callable holds a node like this
    unless_callable: str | None = None
    # sinks like the first are out, unless their callable holds a node like the second
    sink_only_if: tuple[str, str] | None = None


def in_set(*names: str) -> str:
    return "(" + " OR ".join(f"sinks LIKE '%|{n}|%'" for n in names) + ")"


def _trait(name: str) -> str:
    return f"traits LIKE '%|{name}|%'"


def _link(name: str) -> str:
    return f"links LIKE '%|{name}|%'"


def _words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


SENSITIVE = "sensitive = 1"
ANY_SINK = "(rule_types <> '' AND rule_types NOT LIKE '%|Log Sink|%')"
STEP_RULES = [
    StepRule("reader", "kind IN ('call', 'call_arg', 'var_access', 'ctor')", "call_id",
             "kind = 'ctor' AND decl_type IN ('java.io.InputStreamReader', 'java.io.BufferedReader')", "id"),
    StepRule("read_line", "TRUE", "id", "kind = 'call' AND callee = 'readLine' AND decl_type = 'java.io.BufferedReader'", "qualifier_id"),
    StepRule("operand", "TRUE", "expr_id", "kind = 'expr'", "id"),
    StepRule("return", "kind = 'return'", "callable_id", "kind = 'call'", "target_id"),
    StepRule("parameter", "kind = 'call_arg'", "target_id", "kind = 'param'", "callable_id"),
    StepRule("message_argument", "TRUE", "id", "kind = 'call_arg' AND callee = 'getMessage'", "qualifier_id"),
    StepRule("argument", "TRUE", "call_id", "kind IN ('call', 'ctor')", "id"),
]
SHELL_STEPS = ("reader", "read_line", "operand", "return", "parameter")
ERR_PRINT = f"({in_set('err_print')} OR ({in_set('out_print')} AND inside LIKE '%|catch|%'))"
CAUGHT = ((2, 3, "TRUE", ("throw",)),)
CHECKED = (f"kind = 'ctor' AND {_trait('throwable+')} AND NOT {_trait('runtime+')} "
           f"AND NOT {_trait('servlet_ex+')}")
CRYPTO = "kind = 'call' AND (" + " OR ".join(
    f"(decl_type = '{t}' AND callee = '{c}')" for _, t, c in C.CRYPTO_RESULTS) + ")"
USER_INPUT = ("kind = 'call' AND callee = 'getParameter' AND decl_type IN "
              "('javax.servlet.http.HttpServletRequest', 'jakarta.servlet.http.HttpServletRequest')")
CIPHER = ("decl_type = 'javax.crypto.Cipher'", "callee = 'init' AND name = 'ENCRYPT_MODE'")
PERMISSION = " OR ".join(f"callee LIKE '{p}'" for p in C.PERMISSION_PATTERNS)
EXEC = ("(kind = 'call' AND decl_type = 'java.lang.Runtime' AND callee = 'exec') OR "
        "(kind = 'ctor' AND decl_type = 'java.lang.ProcessBuilder')")

TEXTLESS = (f"kind = 'literal' OR decl_type IN ({_words(C.SIMPLE_TYPES)}) OR {_trait('reflect_type')} "
            f"OR (kind IN ('call', 'call_arg') AND ({PERMISSION}))")

PRINTED = "(kind = 'call_arg' AND decl_type = 'java.io.PrintWriter' AND callee IN ('println', 'write'))"

RULES: dict[str, Rule] = {r.rule_id: r for r in [
    Rule("201", "Insertion of sensitive information into sent data",
         SENSITIVE, in_set("leak", "transmit")),
    Rule("208-header", "Possible timing attack against a client-supplied token",
         f"kind = 'call' AND callee = 'getHeader' AND lower(name) IN ({_words(C.TOKEN_HEADERS)})",
         in_set("compare_header"), barriers=False, skip_tests=False),
    Rule("208-possible", "Possible timing attack against signature validation",
         CRYPTO, in_set("compare"), barriers=False, skip_tests=False, source_needs=CIPHER),
    Rule("208-signature", "Timing attack against signature validation",
         CRYPTO, in_set("compare"), barriers=False, skip_tests=False,
         source_needs=("TRUE", USER_INPUT), sink_needs=("TRUE", USER_INPUT)),
    Rule("209", "Sensitive information flows into an exception and an error message",
         SENSITIVE, f"({in_set('print', 'servlet', 'leak')} OR {ERR_PRINT})",
         steps=((1, 2, CHECKED), *CAUGHT)),
    Rule("209-direct", "Sensitive information in an error message",
         SENSITIVE, f"{in_set('print', 'error', 'servlet', 'leak')} AND inside LIKE '%|catch:checked|%'"),
    Rule("214", "Sensitive information passed to a process",
         SENSITIVE, f"({in_set('process')} OR rule_types LIKE '%|IPC Sink|%')"),
    Rule("215-debug", "Sensitive data in debug code",
         SENSITIVE, f"{ANY_SINK} AND directly LIKE '%|then:debug|%'", skip_tests=False,
         unless_callable=f"lower(callee) LIKE '{C.SANITIZER_PATTERN}'"),
    Rule("215-webview", "Webview debugging enabled",
         "kind = 'literal' AND name = 'true'", in_set("webview"), barriers=False, skip_tests=False),
    Rule("532", "Sensitive information written to a log",
         "secret_name = 1 AND annotated = 0", f"({in_set('logging')} OR rule_types LIKE '%|Log Sink|%')",
         barrier_in=True, unless_callable=PERMISSION, extra_barriers=TEXTLESS),
    Rule("535", "Sensitive data flows into a shell command whose error output is exposed",
         f"{SENSITIVE} OR ({USER_INPUT})",
         f"({ERR_PRINT} OR {in_set('error', 'servlet')} OR {PRINTED})", skip_tests=False,
         steps=((1, 2, EXEC), (2, 3, "callee = 'getErrorStream' AND decl_type = 'java.lang.Process'"),
                (3, 3, "TRUE", SHELL_STEPS))),
    Rule("536", "Sensitive information flows into a servlet exception and an error message",
         SENSITIVE, f"({in_set('print', 'servlet')} OR {ERR_PRINT} OR {ANY_SINK})",
         steps=((1, 2, f"kind = 'ctor' AND {_trait('servlet_ex+')}"), *CAUGHT)),
    Rule("536-direct", "Servlet error message with sensitive information",
         SENSITIVE, f"({ERR_PRINT} OR {in_set('servlet', 'error', 'io')} OR {ANY_SINK}) "
                    "AND inside LIKE '%|catch:servlet|%'"),
    Rule("537", "Sensitive information flows into a runtime exception and an error message",
         SENSITIVE, f"({in_set('print', 'servlet')} OR {ERR_PRINT})",
         steps=((1, 2, f"kind = 'ctor' AND {_trait('runtime+')}"), *CAUGHT)),
    Rule("537-direct", "Runtime error message with sensitive information",
         SENSITIVE, f"{in_set('print', 'error', 'servlet')} AND inside LIKE '%|catch:runtime|%'"),
    Rule("538", "Sensitive information in a file others can read",
         SENSITIVE, f"{in_set('file_writer')} AND {_link('temp_writer')}"),
    Rule("548-listing", "Directory listing exposed",
         "kind = 'call' AND decl_type = 'java.io.File' AND callee = 'listFiles'",
         in_set("print", "servlet"), skip_tests=False,
         sink_only_if=("name = 'getName'", "callee = 'getAbsolutePath'")),
    Rule("550", "Sensitive information in a server error message",
         SENSITIVE, f"({in_set('print', 'servlet', 'framework')} OR {ERR_PRINT})", skip_tests=False,
         steps=((1, 2, f"kind = 'ctor' AND {_trait('server_ex')}"),
                (2, 3, "TRUE", ("throw", "throw_caller")), (3, 3, "TRUE", ("message_argument", "parameter")))),
    Rule("598", "Sensitive information in the query string of a GET request",
         SENSITIVE, f"{_link('get_url')} AND {_link('query_text')}", skip_tests=False),
]}


@dataclass
class Prepared:
    """Flagged nodes and edges, written once and shared by all rules of a run.

    Derived steps and links are made when a rule first asks for them."""

    nodes: DataFrame
    edges: DataFrame
    closure: DataFrame | None = None
    options: dict = field(default_factory=dict)
    _made: dict = field(default_factory=dict)

    def once(self, name: str, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def walks(self, barred: bool) -> list[DataFrame] | None:
        """Walks that all rules with these barriers follow; the frontier form has none."""
        if self.options.get("form") != "doubling":
            return None
        return self.once(f"walks {barred}", lambda: R.doubled_walks(
            R.without_barriers(self.edges, _ids(self, "barrier = 1")) if barred else self.edges, max_iter=self.options.get("max_iter")))

    @property
    def derived(self) -> DataFrame:
        """Steps of STEP_RULES and of exceptions, one call deep as the rules want it."""
        def make():
            throws = self.nodes.filter("throw_id IS NOT NULL").select(F.col("id").alias("node"), "callable_id", F.col("decl_type").alias("type"))
            calls = self.nodes.filter("kind IN ('call', 'ctor') AND target_id IS NOT NULL").select(
                F.col("callable_id").alias("caller_id"), F.col("target_id").alias("callee_id"))
            return written(derived_steps(self.nodes, STEP_RULES).unionByName(
                exception_steps(throws, catch_uses(self.nodes), calls, self.closure, deep=False)))
        return self.once("derived", make)

    @property
    def linked(self) -> DataFrame:
        """Nodes with ``links``, a set of what is true of them by way of others.

        Only the sets are written: what a rule asks of the nodes beside them is tested before the join."""
        sets = self.once("links", lambda: written(
            link_marks(self).groupBy(F.col("node").alias("id")).agg(joined_set(F.collect_set("link")).alias("links"))))
        return self.nodes.join(sets, "id", "left").na.fill("", ["links"])


def prepare(facts: Facts, closure: DataFrame, with_blocks: bool = True, **options) -> Prepared:
    flagged = written(flag_nodes(facts, closure, with_blocks, options.get("form", "frontier")).na.fill(0, ["annotated"]))
    return Prepared(flagged, written(facts.edges.select("src", "dst")), closure, options)


def link_marks(p: Prepared) -> DataFrame:
    """(node, link): ``temp_writer`` writes to a file in the temporary folder, ``get_url`` flows into the address of a
    GET request, ``query_text`` is or holds, as an operand at any depth, a text with a query parameter."""
    form = p.options.get("form", "frontier")
    local = written(R.local_edges(p.edges, p.nodes))
    walks = R.doubled_walks(local) if form == "doubling" else None

    def along(starts: DataFrame, by=(), back: bool = True) -> DataFrame:
        """Nodes of the same callable from which a start is reached, or that a start reaches."""
        if walks is not None:
            return written(R.reach_along(walks, starts, by, back))
        turned = local.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if back else local
        return R.reach_nodes(turned, starts, by=by, form=form)

    def picked(predicate: str, column: str = "id") -> DataFrame:
        return p.nodes.filter(predicate).select(F.col(column).alias("node")).filter("node IS NOT NULL")

    def among(marks: DataFrame, predicate: str) -> DataFrame:
        return marks.join(picked(predicate), "node", "left_semi")

    def qualifiers(calls: DataFrame) -> DataFrame:
        return (p.nodes.select(F.col("id").alias("node"), F.col("qualifier_id").alias("_on")).join(calls, "node")
                .select(F.col("_on").alias("node")).filter("node IS NOT NULL").distinct())

    # connections whose method is set, and those whose method is set to GET
    method = "kind = 'call' AND callee = 'setRequestMethod'"
    starts = picked(method, "qualifier_id").withColumn("by", F.lit("any")).unionByName(
        picked(f"{method} AND name = 'GET'", "qualifier_id").withColumn("by", F.lit("get")))
    marks = along(starts, ["by"])
    opened = p.nodes.filter("kind = 'call' AND callee = 'openConnection'").select(F.col("id").alias("node"), "decl_type")
    got = opened.join(marks.filter("by = 'get'"), "node", "left_semi")
    unset = opened.join(marks.filter("by = 'any'"), "node", "left_anti")
    good = written(got.unionByName(unset).distinct())
    starts = qualifiers(good.filter("decl_type = 'java.net.URL'").select("node")).withColumn("by", F.lit("url")).unionByName(
        qualifiers(good.filter("decl_type = 'java.net.HttpURLConnection'").select("node")).withColumn("by", F.lit("converted")))
    marks = along(starts, ["by"])
    converted = among(marks.filter("by = 'converted'").select("node"), "kind = 'call' AND callee = 'toURL'")
    from_uri = along(qualifiers(converted))
    address = "kind = 'call_arg' AND callee = '<init>' AND decl_type = "
    ends = (picked(f"{address}'org.apache.http.client.methods.HttpGet'")
            .unionByName(among(marks.filter("by = 'url'").select("node"), f"{address}'java.net.URL'"))
            .unionByName(among(from_uri, f"{address}'java.net.URI'")))
    get_url = along(ends)

    # temporary folder to file, file to writer, writer to the calls made on it
    folder = along(picked("kind = 'call' AND decl_type = 'java.lang.System' AND callee = 'getProperty' "
                          "AND name = 'java.io.tmpdir'"), back=False)
    files = among(folder, "kind = 'ctor' AND decl_type = 'java.io.File'")
    writers = among(R.reach_nodes(p.edges, files, form=form, walks=p.walks(False)), "kind = 'ctor' AND decl_type = 'java.io.FileWriter'")
    on = along(writers, back=False).withColumnRenamed("node", "qualifier_id")
    temp = p.nodes.filter("kind = 'call_arg'").select(F.col("id").alias("node"), "qualifier_id").join(on, "qualifier_id", "left_semi")

    # operand trees: a node has one parent, so that pointer jumping follows all paths at once
    up = p.nodes.filter("expr_id IS NOT NULL").select(F.col("id").alias("src"), F.col("expr_id").alias("dst"))
    holds = p.nodes.filter(has_query_param("name")).select(F.col("id").alias("node"))
    query = R.reach_nodes(up, holds, form="doubling")
    named = [("temp_writer", temp.select("node")), ("get_url", get_url), ("query_text", query)]
    out = None
    for link, nodes in named:
        rows = nodes.withColumn("link", F.lit(link))
        out = rows if out is None else out.unionByName(rows)
    return out


def _ids(p: Prepared, predicate: str) -> DataFrame:
    return (p.linked if "links " in predicate else p.nodes).filter(predicate).select(F.col("id").alias("node"))


def _needs(p: Prepared, picked: DataFrame, needs) -> DataFrame:
    """Keep picked nodes outside the subset, and those reached from the origin."""
    if needs is None:
        return picked
    subset, origin = needs
    hit = R.reach_nodes(p.edges, _ids(p, origin), form=p.options.get("form", "frontier"), walks=p.walks(False))
    if subset == "TRUE":
        return picked.join(hit, "node", "left_semi")
    free = picked.join(_ids(p, subset), "node", "left_anti")
    bound = picked.join(_ids(p, subset), "node", "left_semi").join(hit, "node", "left_semi")
    return free.unionByName(bound)


def _sources(p: Prepared, rule: Rule) -> DataFrame:
    return _needs(p, _ids(p, rule.source), rule.source_needs)


def _sink_predicate(rule: Rule) -> str:
    return rule.sink + (" AND test_path = 0" if rule.skip_tests else "")


def _sinks(p: Prepared, rule: Rule) -> DataFrame:
    sink = _sink_predicate(rule)
    sinks = (p.linked if "links " in sink else p.nodes).filter(sink).select(F.col("id").alias("node"), "callable_id")

    def callables(predicate):
        return p.nodes.filter(predicate).select("callable_id").distinct()
    if rule.unless_callable:
        sinks = sinks.join(callables(rule.unless_callable), "callable_id", "left_anti")
    if rule.sink_only_if:
        narrow = p.nodes.filter(rule.sink_only_if[0]).select(F.col("id").alias("node"), "callable_id")
        bad = narrow.join(callables(rule.sink_only_if[1]), "callable_id", "left_anti").select("node")
        sinks = sinks.join(bad, "node", "left_anti")
    return _needs(p, sinks.select("node"), rule.sink_needs)


def _where(rows: DataFrame, wanted: Sequence[tuple], *keep) -> DataFrame:
    """``keep`` and the fields of the struct for every row and every (condition, struct) of ``wanted`` that holds: one pass over the rows."""
    found = F.array_compact(F.array(*[F.when(F.expr(c) if isinstance(c, str) else c, fields) for c, fields in wanted]))
    return rows.select(*keep, F.explode(found).alias("_found")).select("*", "_found.*").drop("_found")


def _joined(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _pooled_ends(p: Prepared, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Sources and sinks (rule_id, node) of several rules; those that a predicate alone picks come from one pass over the nodes."""
    def pool(predicate, one, alone):
        wanted = [(predicate(r), F.struct(F.lit(r.rule_id).alias("rule_id"))) for r in rules if not alone(r)]
        parts = [_where(p.nodes, wanted, F.col("id").alias("node"))] if wanted else []
        return _joined(parts + [one(p, r).withColumn("rule_id", F.lit(r.rule_id)) for r in rules if alone(r)])
    return (pool(lambda r: r.source, _sources, lambda r: r.source_needs or "links " in r.source),
            pool(_sink_predicate, _sinks, lambda r: r.sink_needs or r.unless_callable or r.sink_only_if or "links " in r.sink))


def _moves(p: Prepared, rule: Rule) -> DataFrame:
    """State changes of a rule: edges into nodes that match one of its steps, and derived steps of the named kinds.

    On the way into a hub the state stays as it is."""
    out = None
    for s1, s2, entered, *kinds in rule.steps:
        if kinds:
            edges = p.derived.filter(F.col("kind").isin(*kinds[0]))
            after = F.when(F.col("last"), F.lit(s2)).otherwise(F.lit(s1))
        else:
            edges, after = p.edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")), F.lit(s2)
        if entered != "TRUE":
            wanted = _ids(p, entered).select(F.col("node").cast("string").alias("dst"))
            edges = edges.join(wanted, "dst", "left_semi")
        step = edges.select("src", F.lit(s1).alias("s1"), "dst", after.alias("s2"))
        out = step if out is None else out.unionByName(step)
    return out


def _pooled_moves(p: Prepared, rules: Sequence[Rule]) -> DataFrame:
    """``_moves`` of several rules with their ``rule_id``: one pass over nodes, edges and derived steps for all of them."""
    entering, derived, parts = [], [], []
    for r in rules:
        for step in r.steps:
            s1, s2, entered, *kinds = step
            rule_id, before = F.lit(r.rule_id).alias("rule_id"), F.lit(s1).alias("s1")
            if not kinds and entered != "TRUE" and "links " not in entered:
                entering.append((entered, F.struct(rule_id, before, F.lit(s2).alias("s2"))))
            elif kinds and entered == "TRUE":
                after = F.when(F.col("last"), F.lit(s2)).otherwise(F.lit(s1)).alias("s2")
                derived.append((F.col("kind").isin(*kinds[0]), F.struct(rule_id, before, after)))
            else:
                parts.append(_moves(p, replace(r, steps=(step,))).withColumn("rule_id", F.lit(r.rule_id)))
    if entering:
        edges = p.edges.select("src", "dst").join(_where(p.nodes, entering, F.col("id").alias("dst")), "dst")
        parts.append(_texts(edges, "src", "dst"))
    if derived:
        parts.append(_where(p.derived, derived, "src", "dst"))
    return _joined(parts)


def _texts(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def _text_walks(walks: list[DataFrame] | None) -> list[DataFrame] | None:
    return None if walks is None else [_texts(w, "src", "dst") for w in walks]


def _barriers(p: Prepared, rule: Rule) -> DataFrame | None:
    what = [x for x in ("barrier = 1" if rule.barriers else None, rule.extra_barriers) if x]
    return _ids(p, " OR ".join(what)) if what else None


def run_rule(p: Prepared, rule: Rule) -> DataFrame:
    """(rule_id, source, sink) of one rule."""
    sources, sinks = _sources(p, rule), _sinks(p, rule)
    barriers = _barriers(p, rule)
    edges = R.local_edges(p.edges, p.nodes) if rule.local else p.edges
    # edges or barriers of its own leave a rule no walks to share
    walks = None if rule.local or rule.barrier_in or rule.extra_barriers else p.walks(rule.barriers)
    if rule.steps:
        # hubs have names, so that all nodes are texts here
        pairs = R.reach_states(_texts(edges, "src", "dst"), _moves(p, rule), _texts(sources, "node"), _texts(sinks, "node"),
                               None if barriers is None else _texts(barriers, "node"), walks=_text_walks(walks), **p.options)
        pairs = pairs.select(*[F.col(c).cast(p.nodes.schema["id"].dataType).alias(c)
                               for c in ("source", "sink")])
    else:
        pairs = R.reach(edges, sources, sinks, barriers, barrier_in=rule.barrier_in, walks=walks, **p.options)
    return pairs.select(F.lit(rule.rule_id).alias("rule_id"), "source", "sink")


def run_rules(p: Prepared, rules: Sequence[Rule]) -> DataFrame:
    """All findings with rule id and message.

    One-state rules with the same barriers share one loop keyed by the rule id, state rules another,
    in either form; rules with barriers of their own run by themselves.
    """
    groups: dict[tuple, list[Rule]] = {}
    for rule in rules:
        alone = rule.rule_id if rule.barrier_in or rule.local or rule.extra_barriers else ""
        groups.setdefault((bool(rule.steps), rule.barriers, alone), []).append(rule)
    out = None
    for (stateful, barred, alone), members in groups.items():
        if alone or len(members) == 1:
            parts = [run_rule(p, r) for r in members]
        else:
            sources, sinks = _pooled_ends(p, members)
            barriers = _ids(p, "barrier = 1") if barred else None
            if stateful:
                kind = p.nodes.schema["id"].dataType
                pairs = R.reach_states(_texts(p.edges, "src", "dst"), _pooled_moves(p, members), _texts(sources, "node"), _texts(sinks, "node"),
                                       None if barriers is None else _texts(barriers, "node"), by=["rule_id"],
                                       walks=_text_walks(p.walks(barred)), ahead=3, **p.options)
                parts = [pairs.withColumns({c: F.col(c).cast(kind) for c in ("source", "sink")})]
            else:
                parts = [R.reach(p.edges, sources, sinks, barriers, by=["rule_id"], walks=p.walks(barred), **p.options)]
        for part in parts:
            part = part.select("rule_id", "source", "sink")
            out = part if out is None else out.unionByName(part)
    message = F.create_map(*[F.lit(x) for r in rules for x in (r.rule_id, r.message)])
    return out.withColumn("message", message[F.col("rule_id")])


# --- rules over text and configuration ----------------------------------------------------

def debuggable_manifests(files: DataFrame, path: str, text: str) -> DataFrame:
    """Application elements with the debuggable attribute on, outside build directories."""
    on = F.col(text).rlike(r'(?s)<application\s[^>]*android:debuggable\s*=\s*"true"')
    built = F.lower(path).rlike(r"(^|/)build/")
    return files.filter(on & ~built)


def listing_enabled(files: DataFrame, text: str) -> DataFrame:
    """Web configurations whose default servlet lists directories."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?s)<servlet>(.*?)</servlet>"), F.lit(1))

    def bad(b):
        return (b.rlike(r"<servlet-class>\s*org\.apache\.catalina\.servlets\.DefaultServlet\s*</servlet-class>")
                & b.rlike(r"(?s)<init-param>\s*<param-name>\s*listings\s*</param-name>\s*"
                          r"<param-value>\s*(?i:true)\s*</param-value>"))
    return files.filter(F.exists(blocks, bad))


def commented_secrets(comments: DataFrame, patterns: DataFrame, on: Sequence[str],
                      comment: str = "comment", pattern: str = "pattern") -> DataFrame:
    """Comments like a sensitive pattern of the same file: equality on the file first."""
    return comments.join(patterns, list(on)).filter(F.expr(f"trim({comment}) LIKE trim({pattern})"))


def test_class_literals(literals: DataFrame, classes: DataFrame, closure: DataFrame,
                        on: Sequence[str] = ("class_id",)) -> DataFrame:
    """Literals inside test classes: by supertype, annotation or name."""
    below = closure.filter("super_type = 'junit.framework.TestCase'").select(
        F.col("type").alias("class_type")).distinct()
    by_type = classes.join(below, "class_type", "left_semi")
    by_mark = classes.filter(F.col("annotation").isin("org.junit.Test", "org.junit.jupiter.api.Test")
                             | F.col("class_name").contains("Test"))
    tests = by_type.select(*on).union(by_mark.select(*on)).distinct()
    return literals.join(tests, list(on), "left_semi")


def source_literals(literals: DataFrame, test_literals: DataFrame, on: Sequence[str]) -> DataFrame:
    """Literals outside test code."""
    return literals.join(test_literals.select(*on).distinct(), list(on), "left_anti")


def backward_slice(edges: DataFrame, nodes: DataFrame, variables: DataFrame, barriers: DataFrame | None = None,
                   **options) -> DataFrame:
    """(variable, origin): everything that flows into a variable without passing a barrier."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    everyone = nodes.select(F.col("id").alias("node"))
    return R.reach(back, variables, everyone, barriers, prune=False, **options).toDF("variable", "origin")
