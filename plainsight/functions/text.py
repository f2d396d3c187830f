"""Column functions over names, lines, paths and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names too generic to be sensitive, and parts that rule a name out.
GENERIC_NAMES = [
    "message", "messages", "msg", "msgs", "text", "texts", "data", "body", "request", "req",
    "context", "contents", "content", "id", "operation", "op", "value", "val", "parent",
    "parents", "child", "children", "xml", "json", "html", "entity", "entities",
]
GENERIC_PARTS = ["name", "project", "id", "location", "node", "subject", "object", "script"]

# Words of sample data in literals.
SAMPLE_WORDS = ["example", "test", "demo", "foo", "bar", "baz", "secret"]

# Whole-name patterns of log-worthy secrets, and the part that rules a name out.
SENSITIVE_NAME_PATTERNS = [
    ".*secret.*", ".*credential.*", ".*passw.*", ".*pwd.*", "pin", ".*apikey.*", "ssn",
    "decryptionkey", "privatekey", "creditcardnumber", "cvv*", ".+token",
]
NOT_SENSITIVE_PATTERN = ".*id.*"

# Words that mark a test path.
TEST_PATH_WORDS = ["test", "tests", "testing", "test-suite", "testcase", "unittest",
                   "integration-test", "spec"]

# English stop words of the usual public list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both each few more "
    "most other some such no nor not only own same so than too very s t can will just don "
    "should now you're you've you'll you'd she's it's that'll don't should've d ll m o re ve y ain "
    "aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn "
    "isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't "
    "weren weren't won won't wouldn wouldn't"
).split()

# Severity bands (low, high) per weakness; everything else takes the default.
SEVERITY_BANDS = {
    "CWE-201": (8, 10), "CWE-208": (6, 8), "CWE-209": (5, 7), "CWE-214": (8, 10),
    "CWE-215": (6, 8), "CWE-531": (5, 7), "CWE-532": (8, 10), "CWE-535": (5, 7),
    "CWE-536": (8, 10), "CWE-537": (5, 7), "CWE-538": (8, 10), "CWE-540": (8, 10),
    "CWE-548": (6, 8), "CWE-550": (8, 10), "CWE-598": (8, 10), "CWE-615": (6, 8),
}
DEFAULT_BAND = (3, 5)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- lines and slices -------------------------------------------------------------------

def slice_columns(line, start_col, end_col, message=None) -> Column:
    """Text between two 1-based columns, clamped to the line; the message when they cross."""
    lo = F.greatest(F.lit(0), _c(start_col) - 1)
    hi = F.least(_c(end_col) - 1, F.length(_c(line)))
    cut = F.substring(_c(line), (lo + 1).cast("int"), (hi - lo).cast("int"))
    return F.when(lo <= hi, cut).otherwise(_c(message) if message is not None else F.lit(None))


def line_window(code, line_no, k: int = 3) -> Column:
    """Lines from k above to k below, clipped at the ends of the file."""
    lines = F.split(_c(code), "\n")
    lo = F.greatest(F.lit(1), _c(line_no) - k)
    hi = F.least(F.size(lines), _c(line_no) + k)
    return F.array_join(F.slice(lines, lo.cast("int"),
                                F.greatest(F.lit(0), hi - lo + 1).cast("int")), "\n")


def add_boundaries(file_id, code) -> Column:
    return F.concat(F.lit("\n\n-----BEGIN FILE: ["), _c(file_id).cast("string"), F.lit("]----- \n"),
                    _c(code), F.lit("\n-----END FILE: ["), _c(file_id).cast("string"), F.lit("]-----"))


# --- names ------------------------------------------------------------------------------

def split_identifier(name) -> Column:
    return F.lower(F.regexp_replace(_c(name), "([a-z])([A-Z])", "$1 $2"))


def drop_stop_words(tokens, extra=()) -> Column:
    stops = F.array(*[F.lit(w) for w in [*STOP_WORDS, *extra]])
    return F.filter(_c(tokens), lambda t: ~F.array_contains(stops, F.lower(t)))


def name_allowed(name) -> Column:
    low = F.lower(_c(name))
    ok = ~low.isin(GENERIC_NAMES)
    for part in GENERIC_PARTS:
        ok = ok & ~low.contains(part)
    return ok


def sensitive_name(name) -> Column:
    low = F.lower(_c(name))
    return (low.rlike("^(?:" + "|".join(SENSITIVE_NAME_PATTERNS) + ")$")
            & ~low.rlike(f"^(?:{NOT_SENSITIVE_PATTERN})$"))


def join_name_context(name, context) -> Column:
    return F.concat_ws(" [SEP] ", split_identifier(name), split_identifier(context))


# --- values -----------------------------------------------------------------------------

def literal_allowed(value) -> Column:
    """Case-sensitive sample words, blanks and one-dot numbers out."""
    return ~_c(value).rlike(rf"^\s*$|^[^.]*\.[0-9]+$|{'|'.join(SAMPLE_WORDS)}")


def clean_config_value(value) -> Column:
    """Value as written to a rule row, or null when it is sample data."""
    v = F.regexp_replace(_c(value), r"[^\x00-\x7F]", "")
    v = F.regexp_replace(v, "[\"'\n]", "")
    v = F.replace(v, F.lit("\\"), F.lit("\\\\"))
    bad = v.rlike(rf"^\s*$|^[^.]*\.[0-9]+$|(?i:{'|'.join(SAMPLE_WORDS)})")
    return F.when(~bad, v)


def clean_comment(value) -> Column:
    v = F.regexp_replace(_c(value), r"^\s+|\s+$", "")
    quoted = v.startswith('"') & v.endswith('"') & (F.length(v) >= 2)
    v = F.when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.replace(F.regexp_replace(v, r"\r?\n\s*", " "), F.lit('"'), F.lit('\\"'))


def clean_value(value) -> Column:
    """No semicolons, no trailing ``,).``, one missing closing parenthesis put back."""
    v = F.regexp_replace(F.replace(_c(value), F.lit(";"), F.lit("")), r"^\s+|\s+$", "")
    v = F.regexp_replace(v, r"[,).]+$", "")
    opened = F.length(v) - F.length(F.replace(v, F.lit("("), F.lit("")))
    closed = F.length(v) - F.length(F.replace(v, F.lit(")"), F.lit("")))
    return F.when(opened > closed, F.concat(v, F.lit(")"))).otherwise(v)


def unpack_pairs(value) -> Column:
    """``{k: v, k: v}`` to its values; null when there are no braces."""
    inner = F.regexp_extract(_c(value), r"\{([^}]+)\}", 1)
    values = F.transform(F.split(inner, ","), lambda p: F.when(
        F.size(F.split(p, ":")) > 1, F.trim(F.element_at(F.split(p, ":"), 2))).otherwise(F.lit("")))
    return F.when(inner != "", values)


def json_from_reply(reply, schema) -> Column:
    """First ``{`` to last ``}`` of a reply, parsed; null when it is not JSON."""
    return F.from_json(F.regexp_extract(_c(reply), r"(?s)\{.*\}", 0), schema)


def yes_no_from_reply(reply, whole_word: bool = False) -> Column:
    low = F.lower(_c(reply))
    hit = low.rlike(r"(^|[^a-z0-9_])yes([^a-z0-9_]|$)") if whole_word else low.contains("yes")
    return F.when(hit, F.lit("Yes")).otherwise(F.lit("No"))


def split_sections(text) -> Column:
    """(prompt, items, code) around two ``+++++`` marks; null fields when there are not two."""
    pattern = r"(?s)^(.*?)\+{5}(.*?)\+{5}(.*)$"

    def part(i):
        return F.when(_c(text).rlike(pattern),
                      F.regexp_replace(F.regexp_extract(_c(text), pattern, i), r"^\s+|\s+$", ""))
    return F.struct(part(1).alias("prompt"), part(2).alias("items"), part(3).alias("code"))


# --- rules, feeds and paths -------------------------------------------------------------

def rule_to_cwe(rule_id) -> Column:
    return F.element_at(F.split(_c(rule_id), "/"), -1)


def path_to_cwe(path) -> Column:
    parts = F.filter(F.split(_c(path), r"[/\\]"), lambda p: p.startswith("CWE-"))
    return F.try_element_at(parts, F.lit(1))


def parse_cpe(uri) -> Column:
    parts = F.split(_c(uri), ":")
    text = F.concat(F.try_element_at(parts, F.lit(5)), F.lit(" version "),
                    F.try_element_at(parts, F.lit(6)), F.lit(" "))
    return F.coalesce(F.when(F.size(parts) > 4, text), F.lit("Unknown"))


def repo_name(code_url, package, references, identifiers, host: str = "https://github.com/") -> Column:
    """Code URL, else package with a slash, else first fix commit, else identifier."""
    url, pkg = _c(code_url), F.trim(_c(package))
    from_url = F.when(url.startswith(host), F.array_join(F.slice(F.split(url, "/"), -2, 2), "/"))
    commit = "https://github\\.com/([^/]+/[^/]+)/commit/"
    hits = F.filter(F.transform(_c(references), lambda r: F.regexp_extract(r, commit, 1)),
                    lambda r: r != "")
    return F.coalesce(from_url, F.when(pkg.contains("/"), pkg),
                      F.try_element_at(hits, F.lit(1)),
                      F.try_element_at(_c(identifiers), F.lit(1)), F.lit("Unknown"))


def is_test_path(path, mode: str = "substring") -> Column:
    """``substring`` follows the rule as it is; ``segment`` wants a whole path word."""
    low = F.lower(_c(path))
    words = "|".join(TEST_PATH_WORDS)
    if mode == "substring":
        return low.rlike(f"(?:{words})")
    return low.rlike(rf"(?:^|[/\\._])(?:{words})(?:$|[/\\._])")


def has_query_param(text) -> Column:
    return _c(text).rlike("[?&][^=\n]*=")


def canonical_path(path, project=None) -> Column:
    """One separator; a repeated leading project name dropped."""
    p = F.regexp_replace(F.regexp_replace(_c(path), r"[/\\]+", "/"), "^Files/", "")
    parts = F.split(p, "/")
    twice = (F.size(parts) > 1) & (F.element_at(parts, 1) == F.try_element_at(parts, F.lit(2)))
    p = F.when(twice, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/")).otherwise(p)
    if project is None:
        return p
    lead = F.concat(_c(project), F.lit("/"))
    return F.when(p.startswith(lead), p).otherwise(F.concat(lead, p))


def normalise_rating(rating) -> Column:
    first = F.upper(F.substring(_c(rating), 1, 1))
    return F.when(first == "Y", F.lit("Y")).otherwise(F.lit("N"))


def severity_band(cwe) -> Column:
    """(low, high) as a struct; the id may come with or without its prefix."""
    full = F.when(_c(cwe).startswith("CWE-"), _c(cwe)).otherwise(F.concat(F.lit("CWE-"), _c(cwe)))

    def band(i):
        out = None
        for key, pair in SEVERITY_BANDS.items():
            out = (F.when(full == key, pair[i]) if out is None else out.when(full == key, pair[i]))
        return out.otherwise(DEFAULT_BAND[i])
    return F.struct(band(0).alias("low"), band(1).alias("high"))


def severity(cwe, *identity) -> Column:
    """A value inside the band, fixed by the identity of the finding."""
    b = severity_band(cwe)
    spread = b.getField("high") - b.getField("low") + 1
    return (b.getField("low") + F.pmod(F.xxhash64(*[_c(i) for i in identity]), spread)).cast("int")


# --- locations --------------------------------------------------------------------------

LOCATION = T.StructType([
    T.StructField("message", T.StructType([T.StructField("text", T.StringType())])),
    T.StructField("physicalLocation", T.StructType([
        T.StructField("artifactLocation", T.StructType([T.StructField("uri", T.StringType())])),
        T.StructField("region", T.StructType([
            T.StructField(n, T.IntegerType())
            for n in ("startLine", "startColumn", "endLine", "endColumn")])),
    ])),
])


def location_fields(loc) -> Column:
    """uri, start and end with their fall-backs; type is the message after the first colon."""
    phys = _c(loc).getField("physicalLocation")
    region = phys.getField("region")
    text = F.coalesce(_c(loc).getField("message").getField("text"), F.lit(""))
    start_line, start_col = region.getField("startLine"), region.getField("startColumn")
    colon = F.instr(text, ":")
    kind = F.when(colon > 0, F.trim(F.substring(text, (colon + 1).cast("int"), F.length(text))))
    uri = F.coalesce(phys.getField("artifactLocation").getField("uri"), F.lit("unknown"))
    first_col = F.coalesce(start_col, F.lit(0))
    return F.struct(
        F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))).alias("uri"),
        start_line.alias("start_line"), first_col.alias("start_col"),
        F.coalesce(region.getField("endLine"), start_line).alias("end_line"),
        F.coalesce(region.getField("endColumn"), first_col).alias("end_col"),
        text.alias("message"), F.coalesce(kind, F.lit("")).alias("type"))
