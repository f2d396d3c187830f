"""The rule pack once more, in SQL written by hand: facts, flags, sinks and rules with their own literals.

Only the input is shared with the Spark side: what kind of node an event is and which types lie below which.  No
predicate, list or catalog of the library is used.
"""

from plainsight.plans.catalog import PLATFORM_TYPES
from plainsight.session import values_sql
from plainsight.workloads.event_facts import SIGNATURE_COLUMNS, SIGNATURES

EDGES_SQL = """edges AS (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, user_id FROM events)"""
_TYPES = values_sql(["type", "super_type"], PLATFORM_TYPES)


def below(column: str, *roots: str) -> str:
    """The type itself or a type under it."""
    names = ", ".join(f"'{r}'" for r in roots)
    return f"({column} IN ({names}) OR {column} IN (SELECT type FROM closure WHERE super_type IN ({names})))"


def under(column: str, root: str) -> str:
    return f"({column} <> '{root}' AND {column} IN (SELECT type FROM closure WHERE super_type = '{root}'))"


NAME_OK = """lower(name) NOT IN ('message','messages','msg','msgs','text','texts','data','body','request','req','context','contents',
  'content','id','operation','op','value','val','parent','parents','child','children','xml','json','html','entity','entities')
  AND NOT regexp_matches(lower(name), 'name|project|id|location|node|subject|object|script')"""

BARRIER = """coalesce((kind IN ('call','call_arg') AND regexp_matches(lower(callee), 'sanitize|encrypt|encode|mask|hash|obfuscate|scramble|anonymize|redact|public'))
  OR (kind IN ('var_access','expr') AND decl_type IN ('java.net.URLEncoder','java.util.Base64','javax.crypto.Cipher','java.security.MessageDigest','java.security.Signature','java.security.KeyStore'))
  OR (kind IN ('call','call_arg') AND decl_type IN ('org.owasp.esapi.ESAPI','org.apache.commons.codec.binary.Base64','org.apache.commons.codec.StringEncoder','com.google.common.hash.Hashing',
    'com.google.common.io.BaseEncoding','org.springframework.security.crypto.Encryptors','org.springframework.security.crypto.bcrypt.BCryptPasswordEncoder','io.jsonwebtoken.JwtBuilder',
    'io.jsonwebtoken.JwtParser','io.jsonwebtoken.Jwt','java.nio.charset.CharsetEncoder','java.util.zip.Deflater'))
  OR (kind IN ('assign','call_arg') AND contains(name, 'public')), FALSE)"""

FACTS_SQL = f"""
sig AS (SELECT * FROM {values_sql(SIGNATURE_COLUMNS, SIGNATURES)}),
{EDGES_SQL},
closure(type, super_type) AS (SELECT type, super_type FROM {_TYPES}
  UNION SELECT c.type, t.super_type FROM closure c JOIN (SELECT * FROM {_TYPES}) t ON c.super_type = t.type),
raw AS (SELECT event_id AS id, user_id, event_type, k, kind, name, callee, decl_type,
  concat('/src/', CASE WHEN user_id % 9 = 0 THEN 'test/' ELSE 'main/' END, 'u', user_id, '.java') AS path,
  concat('u', user_id, '.java') AS file_name, user_id * 100 + day(ts) // 8 AS callable_id, event_id // 10 AS b1, event_id // 100 + 3 AS b2,
  CASE WHEN kind IN ('call','call_arg') AND k % 2 = 0 THEN before END AS qualifier_id,
  CASE WHEN kind IN ('call','call_arg','var_access','ctor') AND k % 3 < 2 THEN after END AS call_id,
  CASE WHEN kind IN ('call','ctor','call_arg') AND k % 5 < 2 THEN user_id * 100 + day(ts) // 8 - 1 END AS target_id,
  CASE WHEN kind IN ('ctor','expr') AND k % 4 <> 1 THEN event_id END AS throw_id,
  CASE WHEN kind IN ('literal','expr','var_access') AND k % 7 < 4 THEN after END AS expr_id,
  kind = 'var_access' AND user_id % 13 = 0 AS annotated
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before,
    lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) JOIN sig USING (event_type, k)),
rs AS (SELECT DISTINCT file_name, name FROM raw WHERE kind = 'var_access' AND user_id % 4 <> 0),
rk AS (SELECT DISTINCT file_name, callee, CASE k % 4 WHEN 0 THEN 'Log Sink' WHEN 1 THEN 'IPC Sink' WHEN 2 THEN 'Print Sink' ELSE 'Network Sink' END AS sink_type
  FROM raw WHERE event_type = 'purchase' AND user_id % 3 = 0),
nodes AS (SELECT n.*, q.callee AS on_callee, q.decl_type AS on_type, q.kind AS on_kind,
  kind = 'var_access' AND (n.file_name, n.name) IN (SELECT (file_name, name) FROM rs) AND {NAME_OK.replace('(name)', '(n.name)')}
    AND NOT coalesce({under('n.decl_type', 'java.lang.Throwable')}, FALSE) AS sensitive,
  n.kind = 'var_access' AND lower(n.name) NOT LIKE '%id%' AND
    regexp_full_match(lower(n.name), '.*secret.*|.*credential.*|.*passw.*|.*pwd.*|pin|.*apikey.*|ssn|decryptionkey|privatekey|creditcardnumber|cvv*|.+token') AS secret,
  regexp_matches(lower(n.path), 'test|spec') AS test_path,
  {BARRIER.replace('(kind', '(n.kind').replace('callee', 'n.callee').replace('decl_type', 'n.decl_type').replace('(name', '(n.name')} AS barrier,
  b1 % 5 <> 4 OR b2 % 5 <> 4 AS in_catch, b1 % 5 IN (0, 3) OR b2 % 5 IN (0, 3) AS in_checked, b1 % 5 = 1 OR b2 % 5 = 1 AS in_servlet,
  b1 % 5 = 2 OR b2 % 5 = 2 AS in_runtime, b1 % 5 = 4 AS in_debug,
  n.kind = 'call_arg' AND (n.file_name, n.callee) IN (SELECT (file_name, callee) FROM rk WHERE sink_type = 'Log Sink') AS log_rule,
  n.kind = 'call_arg' AND (n.file_name, n.callee) IN (SELECT (file_name, callee) FROM rk WHERE sink_type = 'IPC Sink') AS ipc_rule,
  n.kind = 'call_arg' AND (n.file_name, n.callee) IN (SELECT (file_name, callee) FROM rk) AS any_rule
  FROM (SELECT raw.* FROM raw) n LEFT JOIN (SELECT id, kind, callee, decl_type FROM raw) q ON q.id = n.qualifier_id)"""
FACTS_SQL = FACTS_SQL.replace("  kind = 'var_access' AND (n.file_name", "  n.kind = 'var_access' AND (n.file_name")

_RESPONSE = "javax.servlet.http.HttpServletResponse"
_ON_WRITER = "on_kind = 'call' AND on_callee = 'getWriter' AND on_type"

#: What each set of sinks is, over the columns of ``nodes``.
SINKS = {
    "logging": """kind = 'call_arg' AND ((decl_type = 'org.apache.logging.log4j.Logger' AND callee IN ('error','warn','info','debug','fatal'))
      OR (decl_type = 'org.slf4j.Logger' AND callee IN ('error','warn','info','debug')))""",
    "servlet": f"""kind = 'call_arg' AND ((decl_type = '{_RESPONSE}' AND callee IN ('sendError','addHeader','setStatus'))
      OR (callee = 'write' AND {_ON_WRITER} = '{_RESPONSE}'))""",
    "print": f"""kind = 'call_arg' AND ((callee IN ('print','println','write') AND {below('decl_type', 'java.io.PrintWriter')})
      OR (callee = 'println' AND decl_type = 'java.io.PrintStream')
      OR (callee IN ('print','println','write') AND {_ON_WRITER} IN ('{_RESPONSE}', 'jakarta.servlet.http.HttpServletResponse'))
      OR (callee = 'sendError' AND decl_type IN ('{_RESPONSE}', 'jakarta.servlet.http.HttpServletResponse')))""",
    "err_print": """kind = 'call_arg' AND callee = 'println' AND (decl_type = 'System.err' OR (decl_type = 'System.out' AND in_catch))""",
    "error": f"""kind IN ('call','call_arg','return') AND callee IN ('getStackTrace','getStackTraceAsString','printStackTrace') AND {below('decl_type', 'java.lang.Throwable')}""",
    "io": "kind = 'call_arg' AND callee IN ('write','store')",
    "spring": """kind = 'call_arg' AND ((decl_type = 'org.springframework.web.server.ResponseStatusException' AND callee = '<init>')
      OR (decl_type = 'org.springframework.http.ResponseEntity' AND callee = 'body'))""",
    "leak": f"kind = 'call_arg' AND decl_type = '{_RESPONSE}' AND callee = 'sendError'",
    "transmit": f"""kind = 'call_arg' AND ((callee = 'setHeader' AND {below('decl_type', _RESPONSE)})
      OR (callee IN ('addHeader','setText') AND {below('decl_type', 'javax.mail.internet.MimeMessage')})
      OR (callee = 'send' AND decl_type = 'javax.mail.Transport') OR (callee = 'write' AND {below('decl_type', 'java.net.Socket')})
      OR (callee = 'write' AND decl_type = 'java.io.FileOutputStream')
      OR (callee = 'writeAttribute' AND {below('decl_type', 'javax.xml.stream.XMLStreamWriter')})
      OR (callee IN ('write','println') AND {_ON_WRITER} = '{_RESPONSE}'))""",
    "process": """kind = 'call_arg' AND ((decl_type = 'java.lang.Runtime' AND callee = 'exec') OR callee = 'ProcessBuilder'
      OR (decl_type = 'java.lang.ProcessBuilder' AND callee = 'command')
      OR (decl_type = 'org.apache.commons.exec.CommandLine' AND callee IN ('addArgument','addArguments'))
      OR (decl_type = 'com.jcraft.jsch.Session' AND callee = 'execCommand')
      OR (callee = 'put' AND on_kind = 'call' AND on_callee = 'environment' AND on_type = 'java.lang.ProcessBuilder'))""",
    "compare_header": """kind = 'call_arg' AND ((decl_type = 'java.lang.String' AND callee IN ('equals','contentEquals','equalsIgnoreCase'))
      OR (decl_type = 'org.apache.commons.lang3.StringUtils' AND callee IN ('equals','equalsAny','equalsAnyIgnoreCase','equalsIgnoreCase')))""",
    "compare": """kind = 'call_arg' AND ((decl_type = 'java.lang.String' AND callee IN ('equals','contentEquals','equalsIgnoreCase'))
      OR (decl_type = 'java.nio.ByteBuffer' AND callee IN ('equals','compareTo')) OR (decl_type = 'java.util.Arrays' AND callee IN ('equals','deepEquals'))
      OR (decl_type = 'java.util.Objects' AND callee = 'deepEquals')
      OR (decl_type = 'org.apache.commons.lang3.StringUtils' AND callee IN ('equals','equalsAny','equalsAnyIgnoreCase','equalsIgnoreCase')))""",
    "webview": "kind = 'call_arg' AND decl_type = 'android.webkit.WebView' AND callee = 'setWebContentsDebuggingEnabled'",
    "framework": f"""kind IN ('call','call_arg','return') AND (
      (decl_type = '@Controller' AND callee IN ('org.springframework.http.ResponseEntity','reactor.core.publisher.Mono','reactor.core.publisher.Flux','getWriter','getOutputStream'))
      OR (decl_type = '@javax.ws.rs.Path' AND callee = 'javax.ws.rs.core.Response') OR (decl_type = '@jakarta.ws.rs.Path' AND callee = 'jakarta.ws.rs.core.Response')
      OR (decl_type = '@Route' AND callee = 'com.vaadin.flow.component.notification.Notification.show')
      OR (callee IN ('getWriter','getOutputStream') AND {below('decl_type', 'com.opensymphony.xwork2.Action')})
      OR (callee = 'play.mvc.Result' AND {below('decl_type', 'play.mvc.Controller')})
      OR (kind = 'return' AND decl_type = '@RestController'))""",
}
ANY_SINK = "(any_rule AND NOT log_rule)"


def sink(*names: str) -> str:
    return "(" + " OR ".join(f"({SINKS[n]})" for n in names) + ")"


# --- flow ------------------------------------------------------------------------------------

#: Edges that do not touch a barrier.
OPEN = "open AS (SELECT src, dst FROM edges WHERE dst IS NOT NULL AND src NOT IN (FROM stops) AND dst NOT IN (FROM stops))"
LOCAL = """local AS (SELECT e.src, e.dst FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.callable_id = b.callable_id)"""
USES = """uses AS (SELECT id AS node, callable_id, decl_type AS caught FROM nodes WHERE kind = 'catch_var'
  UNION SELECT m.id, v.callable_id, v.decl_type FROM nodes m JOIN nodes v ON v.id = m.qualifier_id WHERE m.kind = 'call' AND m.callee = 'getMessage' AND v.kind = 'catch_var')"""
SAME = "SELECT t.id AS src, u.node AS dst FROM nodes t JOIN uses u ON u.callable_id = t.callable_id WHERE t.throw_id IS NOT NULL"
CALLER = """SELECT t.id AS src, u.node AS dst FROM nodes t JOIN nodes c ON c.kind IN ('call','ctor') AND c.target_id = t.callable_id
  JOIN uses u ON u.callable_id = c.callable_id WHERE t.throw_id IS NOT NULL AND (t.decl_type = u.caught OR (t.decl_type, u.caught) IN (SELECT (type, super_type) FROM closure))"""
SHELL = """SELECT a.id AS src, c.id AS dst FROM nodes a JOIN nodes c ON a.call_id = c.id WHERE c.kind = 'ctor' AND c.decl_type IN ('java.io.InputStreamReader','java.io.BufferedReader')
  UNION SELECT q.id, c.id FROM nodes q JOIN nodes c ON c.qualifier_id = q.id WHERE c.kind = 'call' AND c.callee = 'readLine' AND c.decl_type = 'java.io.BufferedReader'
  UNION SELECT o.id, x.id FROM nodes o JOIN nodes x ON o.expr_id = x.id WHERE x.kind = 'expr'
  UNION SELECT r.id, c.id FROM nodes r JOIN nodes c ON c.target_id = r.callable_id WHERE r.kind = 'return' AND c.kind = 'call'
  UNION SELECT a.id, p.id FROM nodes a JOIN nodes p ON p.callable_id = a.target_id WHERE a.kind = 'call_arg' AND p.kind = 'param'"""
MESSAGE = """SELECT q.id AS src, a.id AS dst FROM nodes q JOIN nodes a ON a.qualifier_id = q.id WHERE a.kind = 'call_arg' AND a.callee = 'getMessage'
  UNION SELECT a.id, p.id FROM nodes a JOIN nodes p ON p.callable_id = a.target_id WHERE a.kind = 'call_arg' AND p.kind = 'param'"""


def entering(condition: str) -> str:
    return f"SELECT src, dst FROM edges WHERE dst IN (SELECT id FROM nodes WHERE {condition})"


def flow(rule_id: str, source: str, target: str, *, barriers: str = "barrier", tests: bool = True, entry: bool = False,
         states: list[tuple[int, int, str]] | None = None, more: tuple[str, ...] = ()) -> str:
    """A rule: sources, sinks, what stops it, and state changes as (before, after, edges)."""
    skip = " AND NOT test_path" if tests else ""
    ctes = [FACTS_SQL, *more, f"stops AS (SELECT id FROM nodes WHERE {barriers})", OPEN,
            f"src AS (SELECT id FROM nodes WHERE coalesce({source}, FALSE) AND id NOT IN (FROM stops))",
            f"snk AS (SELECT id FROM nodes WHERE coalesce({target}, FALSE){skip})"]
    if states is None:
        into = " WHERE e.dst NOT IN (FROM src)" if entry else ""
        ctes.append(f"r(source, node) AS (SELECT id, id FROM src UNION SELECT r.source, e.dst FROM r JOIN open e ON e.src = r.node{into})")
        last = ""
    else:
        moves = " UNION ".join(f"SELECT src, {a} AS s1, dst, {b} AS s2 FROM ({edges})" for a, b, edges in states)
        ctes.append(f"""mv AS (SELECT * FROM (SELECT src, s AS s1, dst, s AS s2 FROM edges, (VALUES (1), (2), (3)) AS v(s) WHERE dst IS NOT NULL UNION {moves})
          WHERE src NOT IN (FROM stops) AND dst NOT IN (FROM stops))""")
        ctes.append("r(source, node, st) AS (SELECT id, id, 1 FROM src UNION SELECT r.source, m.dst, m.s2 FROM r JOIN mv m ON m.src = r.node AND m.s1 = r.st)")
        last = "st = 3 AND "
    return (f"WITH RECURSIVE {', '.join(ctes)} SELECT DISTINCT '{rule_id}' AS rule_id, source, node AS sink FROM r WHERE {last}node IN (FROM snk)")


def reached(name: str, edges: str, start: str, back: bool = False) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    return f"{name}(node) AS ({start} UNION SELECT e.{b} FROM {name} JOIN {edges} e ON e.{a} = {name}.node WHERE e.{b} IS NOT NULL)"


_NONE = "FALSE"
_CRYPTO = """kind = 'call' AND ((decl_type IN ('javax.crypto.Mac','javax.crypto.Cipher') AND callee = 'doFinal') OR (decl_type = 'java.security.Signature' AND callee = 'sign'))"""
_USER = "kind = 'call' AND callee = 'getParameter' AND decl_type IN ('javax.servlet.http.HttpServletRequest','jakarta.servlet.http.HttpServletRequest')"
_CHECKED = f"kind = 'ctor' AND {under('decl_type', 'java.lang.Throwable')} AND NOT {under('decl_type', 'java.lang.RuntimeException')} AND NOT {under('decl_type', 'javax.servlet.ServletException')}"
_SERVER = below("decl_type", "java.sql.SQLException", "org.springframework.web.client.HttpServerErrorException", "org.springframework.web.server.ResponseStatusException",
                "org.apache.http.ApplicationServerException", "java.net.BindException", "java.net.ConnectException", "java.net.SocketTimeoutException",
                "java.net.ProtocolException", "org.springframework.boot.web.server.WebServerException",
                "org.springframework.http.converter.HttpMessageNotWritableException", "javax.jms.JMSException", "javax.ejb.EJBException")
_PERMITTED = "(callee LIKE '%Permission%' OR callee LIKE '%authorize%' OR callee LIKE '%canAccess%' OR callee LIKE '%isAuthorized%')"
_SIMPLE = """decl_type IN ('boolean','byte','char','double','float','int','long','short','java.lang.Boolean','java.lang.Byte','java.lang.Character',
  'java.lang.Double','java.lang.Float','java.lang.Integer','java.lang.Long','java.lang.Number','java.lang.Short')"""


def _caught(rule_id: str, made: str, target: str, tests: bool = True) -> str:
    return flow(rule_id, "sensitive", target, tests=tests, more=(USES,), states=[(1, 2, entering(made)), (2, 3, SAME)])


# which calls open a connection that sends a GET, and what flows into their address
_QUALIFIERS = "SELECT qualifier_id FROM nodes WHERE kind = 'call' AND callee = 'setRequestMethod'"
_GET_URL = (
    LOCAL,
    reached("set_any", "local", f"{_QUALIFIERS} AND qualifier_id IS NOT NULL", True),
    reached("set_get", "local", f"{_QUALIFIERS} AND name = 'GET' AND qualifier_id IS NOT NULL", True),
    """opened AS (SELECT id, decl_type, qualifier_id FROM nodes WHERE kind = 'call' AND callee = 'openConnection' AND (id IN (FROM set_get) OR id NOT IN (FROM set_any)))""",
    reached("to_open", "local", "SELECT qualifier_id FROM opened WHERE decl_type = 'java.net.URL' AND qualifier_id IS NOT NULL", True),
    reached("to_http", "local", "SELECT qualifier_id FROM opened WHERE decl_type = 'java.net.HttpURLConnection' AND qualifier_id IS NOT NULL", True),
    reached("to_url", "local", "SELECT qualifier_id FROM nodes WHERE kind = 'call' AND callee = 'toURL' AND id IN (FROM to_http) AND qualifier_id IS NOT NULL", True),
    reached("address", "local", """SELECT id FROM nodes WHERE kind = 'call_arg' AND callee = '<init>' AND (decl_type = 'org.apache.http.client.methods.HttpGet'
      OR (decl_type = 'java.net.URL' AND id IN (FROM to_open)) OR (decl_type = 'java.net.URI' AND id IN (FROM to_url)))""", True),
    reached("query_text", "(SELECT id AS src, expr_id AS dst FROM nodes)", "SELECT id FROM nodes WHERE regexp_matches(name, '[?&][^=\\n]*=')"),
)
_TEMP = (
    LOCAL,
    reached("folder", "local", "SELECT id FROM nodes WHERE kind = 'call' AND decl_type = 'java.lang.System' AND callee = 'getProperty' AND name = 'java.io.tmpdir'"),
    reached("file", "edges", "SELECT id FROM nodes WHERE kind = 'ctor' AND decl_type = 'java.io.File' AND id IN (FROM folder)"),
    reached("writer", "local", "SELECT id FROM nodes WHERE kind = 'ctor' AND decl_type = 'java.io.FileWriter' AND id IN (FROM file)"),
)

RULE_SQL = {
    "201": flow("201", "sensitive", sink("leak", "transmit")),
    "208-header": flow("208-header", """kind = 'call' AND callee = 'getHeader' AND lower(name) IN ('x-auth-token','x-csrf-token','http_x_csrf_token','x-csrf-param',
      'x-csrf-header','x-api-key','authorization','proxy-authorization')""", sink("compare_header"), barriers=_NONE, tests=False),
    "208-possible": flow("208-possible", f"""{_CRYPTO} AND (NOT coalesce(decl_type = 'javax.crypto.Cipher', FALSE) OR id IN (FROM ciphered))""", sink("compare"), barriers=_NONE, tests=False,
                         more=(reached("ciphered", "edges", "SELECT id FROM nodes WHERE callee = 'init' AND name = 'ENCRYPT_MODE'"),)),
    "208-signature": flow("208-signature", f"{_CRYPTO} AND id IN (FROM given)", f"{sink('compare')} AND id IN (FROM given)", barriers=_NONE, tests=False,
                          more=(reached("given", "edges", f"SELECT id FROM nodes WHERE {_USER}"),)),
    "209": _caught("209", _CHECKED, sink("print", "servlet", "leak", "err_print")),
    "209-direct": flow("209-direct", "sensitive", f"{sink('print', 'error', 'servlet', 'leak')} AND in_checked"),
    "214": flow("214", "sensitive", f"({sink('process')} OR ipc_rule)"),
    "215-debug": flow("215-debug", "sensitive", f"{ANY_SINK} AND in_debug AND callable_id NOT IN (SELECT callable_id FROM nodes WHERE lower(callee) LIKE '%sanitize%')", tests=False),
    "215-webview": flow("215-webview", "kind = 'literal' AND name = 'true'", sink("webview"), barriers=_NONE, tests=False),
    "532": flow("532", "secret AND NOT annotated", f"({sink('logging')} OR log_rule) AND callable_id NOT IN (SELECT callable_id FROM nodes WHERE {_PERMITTED})",
                barriers=f"""barrier OR kind = 'literal' OR {_SIMPLE} OR {below('decl_type', 'java.lang.reflect.Type')} OR (kind IN ('call','call_arg') AND {_PERMITTED})""", entry=True),
    "535": flow("535", f"sensitive OR ({_USER})", f"""({sink('err_print', 'error', 'servlet')} OR (kind = 'call_arg' AND decl_type = 'java.io.PrintWriter' AND callee IN ('println','write')))""",
                tests=False, states=[(1, 2, entering("(kind = 'call' AND decl_type = 'java.lang.Runtime' AND callee = 'exec') OR (kind = 'ctor' AND decl_type = 'java.lang.ProcessBuilder')")),
                                     (2, 3, entering("callee = 'getErrorStream' AND decl_type = 'java.lang.Process'")), (3, 3, SHELL)]),
    "536": _caught("536", f"kind = 'ctor' AND {under('decl_type', 'javax.servlet.ServletException')}", f"({sink('print', 'servlet', 'err_print')} OR {ANY_SINK})"),
    "536-direct": flow("536-direct", "sensitive", f"({sink('err_print', 'servlet', 'error', 'io')} OR {ANY_SINK}) AND in_servlet"),
    "537": _caught("537", f"kind = 'ctor' AND {under('decl_type', 'java.lang.RuntimeException')}", sink("print", "servlet", "err_print")),
    "537-direct": flow("537-direct", "sensitive", f"{sink('print', 'error', 'servlet')} AND in_runtime"),
    "538": flow("538", "sensitive", "kind = 'call_arg' AND decl_type = 'java.io.Writer' AND callee = 'write' AND qualifier_id IN (FROM writer)", more=_TEMP),
    "548-listing": flow("548-listing", "kind = 'call' AND decl_type = 'java.io.File' AND callee = 'listFiles'", f"""{sink('print', 'servlet')} AND NOT (coalesce(name = 'getName', FALSE)
      AND callable_id NOT IN (SELECT callable_id FROM nodes WHERE callee = 'getAbsolutePath'))""", tests=False),
    "550": flow("550", "sensitive", sink("print", "servlet", "framework", "err_print"), tests=False, more=(USES,),
                states=[(1, 2, entering(f"kind = 'ctor' AND {_SERVER}")), (2, 3, f"{SAME} UNION {CALLER}"), (3, 3, MESSAGE)]),
    "598": flow("598", "sensitive", "id IN (FROM address) AND id IN (FROM query_text)", tests=False, more=_GET_URL),
}
