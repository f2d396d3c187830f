"""Fixed values of the rule pack: sinks, barriers, types and messages, as tables.

They must equal the rules they stand for, so they are kept as plain rows.
"""

# Sink sets as (set, declaring type, holds for subtypes, callee).
# A type of * stands for any declaring type.
_LOG4J, _SLF4J = "org.apache.logging.log4j.Logger", "org.slf4j.Logger"
_RESPONSE, _RESPONSE_JAKARTA = ("javax.servlet.http.HttpServletResponse",
                                "jakarta.servlet.http.HttpServletResponse")
_MIME, _STRING_UTILS = "javax.mail.internet.MimeMessage", "org.apache.commons.lang3.StringUtils"

SINK_CATALOG = [
    ("logging", _LOG4J, 0, "error"), ("logging", _LOG4J, 0, "warn"), ("logging", _LOG4J, 0, "info"),
    ("logging", _LOG4J, 0, "debug"), ("logging", _LOG4J, 0, "fatal"),
    ("logging", _SLF4J, 0, "error"), ("logging", _SLF4J, 0, "warn"), ("logging", _SLF4J, 0, "info"),
    ("logging", _SLF4J, 0, "debug"),
    ("servlet", _RESPONSE, 0, "sendError"), ("servlet", _RESPONSE, 0, "addHeader"),
    ("servlet", _RESPONSE, 0, "setStatus"),
    ("print", "java.io.PrintWriter", 1, "print"), ("print", "java.io.PrintWriter", 1, "println"),
    ("print", "java.io.PrintWriter", 1, "write"), ("print", "java.io.PrintStream", 0, "println"),
    ("print", _RESPONSE, 0, "sendError"), ("print", _RESPONSE_JAKARTA, 0, "sendError"),
    ("err_print", "System.err", 0, "println"),
    ("out_print", "System.out", 0, "println"),
    ("error", "java.lang.Throwable", 1, "getStackTrace"),
    ("error", "java.lang.Throwable", 1, "getStackTraceAsString"),
    ("error", "java.lang.Throwable", 1, "printStackTrace"),
    ("io", "*", 0, "write"), ("io", "*", 0, "store"),
    ("spring", "org.springframework.web.server.ResponseStatusException", 0, "<init>"),
    ("spring", "org.springframework.http.ResponseEntity", 0, "body"),
    ("leak", _RESPONSE, 0, "sendError"),
    ("transmit", _RESPONSE, 1, "setHeader"), ("transmit", _MIME, 1, "addHeader"),
    ("transmit", _MIME, 1, "setText"), ("transmit", "javax.mail.Transport", 0, "send"),
    ("transmit", "java.net.Socket", 1, "write"), ("transmit", "java.io.FileOutputStream", 0, "write"),
    ("transmit", "javax.xml.stream.XMLStreamWriter", 1, "writeAttribute"),
    ("compare_header", "java.lang.String", 0, "equals"),
    ("compare_header", "java.lang.String", 0, "contentEquals"),
    ("compare_header", "java.lang.String", 0, "equalsIgnoreCase"),
    ("compare_header", _STRING_UTILS, 0, "equals"), ("compare_header", _STRING_UTILS, 0, "equalsAny"),
    ("compare_header", _STRING_UTILS, 0, "equalsAnyIgnoreCase"),
    ("compare_header", _STRING_UTILS, 0, "equalsIgnoreCase"),
    ("compare", "java.lang.String", 0, "equals"), ("compare", "java.lang.String", 0, "contentEquals"),
    ("compare", "java.lang.String", 0, "equalsIgnoreCase"),
    ("compare", "java.nio.ByteBuffer", 0, "equals"), ("compare", "java.nio.ByteBuffer", 0, "compareTo"),
    ("compare", "java.util.Arrays", 0, "equals"), ("compare", "java.util.Arrays", 0, "deepEquals"),
    ("compare", "java.util.Objects", 0, "deepEquals"),
    ("compare", _STRING_UTILS, 0, "equals"), ("compare", _STRING_UTILS, 0, "equalsAny"),
    ("compare", _STRING_UTILS, 0, "equalsAnyIgnoreCase"),
    ("compare", _STRING_UTILS, 0, "equalsIgnoreCase"),
    ("process", "java.lang.Runtime", 0, "exec"), ("process", "*", 0, "ProcessBuilder"),
    ("process", "java.lang.ProcessBuilder", 0, "command"),
    ("process", "org.apache.commons.exec.CommandLine", 0, "addArgument"),
    ("process", "org.apache.commons.exec.CommandLine", 0, "addArguments"),
    ("process", "com.jcraft.jsch.Session", 0, "execCommand"),
    ("url", "org.apache.http.client.methods.HttpGet", 0, "<init>"),
    ("url", "java.net.URL", 0, "<init>"), ("url", "java.net.URI", 0, "<init>"),
    ("file_writer", "java.io.Writer", 0, "write"),
    ("webview", "android.webkit.WebView", 0, "setWebContentsDebuggingEnabled"),
]

# Sinks by what their call is made on, as (set, declaring type of the qualifier's call,
# callee of the qualifier, callee).
QUALIFIER_SINKS = [
    ("servlet", _RESPONSE, "getWriter", "write"),
    ("print", _RESPONSE, "getWriter", "print"), ("print", _RESPONSE, "getWriter", "println"),
    ("print", _RESPONSE, "getWriter", "write"), ("print", _RESPONSE_JAKARTA, "getWriter", "print"),
    ("print", _RESPONSE_JAKARTA, "getWriter", "println"), ("print", _RESPONSE_JAKARTA, "getWriter", "write"),
    ("transmit", _RESPONSE, "getWriter", "write"), ("transmit", _RESPONSE, "getWriter", "println"),
    ("process", "java.lang.ProcessBuilder", "environment", "put"),
]

# Framework returns and calls that answer a client, as (enclosing annotation or
# supertype, returned type or callee); a return of any type counts in a @RestController.
FRAMEWORK_ANSWERS = [
    ("@Controller", "org.springframework.http.ResponseEntity"),
    ("@Controller", "reactor.core.publisher.Mono"), ("@Controller", "reactor.core.publisher.Flux"),
    ("@Controller", "getWriter"), ("@Controller", "getOutputStream"),
    ("@javax.ws.rs.Path", "javax.ws.rs.core.Response"),
    ("@jakarta.ws.rs.Path", "jakarta.ws.rs.core.Response"),
    ("@Route", "com.vaadin.flow.component.notification.Notification.show"),
    ("com.opensymphony.xwork2.Action", "getWriter"),
    ("com.opensymphony.xwork2.Action", "getOutputStream"), ("play.mvc.Controller", "play.mvc.Result"),
]
ANY_RETURN_TYPE = "@RestController"
# an annotation stands for itself, a supertype for every class below it
SINK_CATALOG += [("framework", t, 0 if t.startswith("@") else 1, c) for t, c in FRAMEWORK_ANSWERS]

# Sets in which the call or the returned value itself is the sink; in all others it is an argument.
RESULT_SETS = ["error", "framework"]

# Crypto results, as (result type, declaring type, callee).
CRYPTO_RESULTS = [
    ("MAC", "javax.crypto.Mac", "doFinal"), ("signature", "java.security.Signature", "sign"),
    ("ciphertext", "javax.crypto.Cipher", "doFinal"),
]

# Client-supplied token headers.
TOKEN_HEADERS = ["x-auth-token", "x-csrf-token", "http_x_csrf_token", "x-csrf-param",
                 "x-csrf-header", "x-api-key", "authorization", "proxy-authorization"]

# Words of sanitising callees, and types whose values or calls are barriers.
BARRIER_WORDS = ["sanitize", "encrypt", "encode", "mask", "hash", "obfuscate", "scramble",
                 "anonymize", "redact", "public"]
BARRIER_VALUE_TYPES = [
    "java.net.URLEncoder", "java.util.Base64", "javax.crypto.Cipher",
    "java.security.MessageDigest", "java.security.Signature", "java.security.KeyStore",
]
BARRIER_CALL_TYPES = [
    "org.owasp.esapi.ESAPI", "org.apache.commons.codec.binary.Base64",
    "org.apache.commons.codec.StringEncoder", "com.google.common.hash.Hashing",
    "com.google.common.io.BaseEncoding", "org.springframework.security.crypto.Encryptors",
    "org.springframework.security.crypto.bcrypt.BCryptPasswordEncoder",
    "io.jsonwebtoken.JwtBuilder", "io.jsonwebtoken.JwtParser", "io.jsonwebtoken.Jwt",
    "java.nio.charset.CharsetEncoder", "java.util.zip.Deflater",
]
BARRIER_VARIABLE_PART = "public"

# Callees that check a permission, and the word of a sanitiser in scope.
PERMISSION_PATTERNS = ["%Permission%", "%authorize%", "%canAccess%", "%isAuthorized%"]
SANITIZER_PATTERN = "%sanitize%"

# Types whose values carry no text: primitive, boxed and number types.
SIMPLE_TYPES = ["boolean", "byte", "char", "double", "float", "int", "long", "short", "java.lang.Boolean",
                "java.lang.Byte", "java.lang.Character", "java.lang.Double", "java.lang.Float",
                "java.lang.Integer", "java.lang.Long", "java.lang.Number", "java.lang.Short"]

# Server-side exceptions of the server error rule.
SERVER_EXCEPTIONS = [
    "java.sql.SQLException", "org.springframework.web.client.HttpServerErrorException",
    "org.springframework.web.server.ResponseStatusException",
    "org.apache.http.ApplicationServerException", "java.net.BindException",
    "java.net.ConnectException", "java.net.SocketTimeoutException", "java.net.ProtocolException",
    "org.springframework.boot.web.server.WebServerException",
    "org.springframework.http.converter.HttpMessageNotWritableException",
    "javax.jms.JMSException", "javax.ejb.EJBException",
]

# Getter callees whose literal argument is a key, not a secret.
KEY_GETTERS = ["getenv", "getParameter", "getProperty", "getInitParameter", "getHeader",
               "getCookie", "getAttribute", "getAuthType", "getRemoteUser", "getResource",
               "getResourceAsStream", "addRequestProperty"]

# Sink types of the sink relation that name a sink method.
SINK_TYPES = ["I/O Sink", "Print Sink", "Network Sink", "Log Sink", "Database Sink", "Email Sink",
              "IPC Sink", "Clipboard Sink", "GUI Display Sink", "RPC Sink",
              "Environment Variable Sink", "Command Execution Sink", "Configuration File Sink"]

# Class numbers of the sink classifier.
SINK_CLASSES = ["N/A", "I/O Sink", "Print Sink", "Network Sink", "Log Sink", "Database Sink",
                "Email Sink", "IPC Sink"]

# Message literals that tell outcomes apart.
OUTCOME_MESSAGES = (
    "Login Successful|Invalid password|Invalid username|Access (Granted|Denied)|"
    "Verification (Successful|Failed)|Authentication (Successful|Failed)|User not found|"
    "Password cannot be empty|Username cannot be empty|Input cannot be null|"
    "Input cannot be empty|'admin' is a reserved keyword|Download Authorized|"
    "Download Denied: Insufficient privileges"
)

# Cut-offs per item category.
THRESHOLDS = {"variables": 0.75, "strings": 0.95, "comments": 0.75, "sinks": 0.5}
FLOW_THRESHOLD = 0.7

# Public supertypes of the platform types above; callers add those of their projects.
PLATFORM_TYPES = [
    ("java.lang.Exception", "java.lang.Throwable"), ("java.lang.Error", "java.lang.Throwable"),
    ("java.lang.RuntimeException", "java.lang.Exception"),
    ("java.lang.IllegalStateException", "java.lang.RuntimeException"),
    ("java.lang.IllegalArgumentException", "java.lang.RuntimeException"),
    ("java.io.IOException", "java.lang.Exception"), ("java.sql.SQLException", "java.lang.Exception"),
    ("javax.servlet.ServletException", "java.lang.Exception"),
    ("javax.servlet.UnavailableException", "javax.servlet.ServletException"),
    ("java.net.SocketException", "java.io.IOException"),
    ("java.net.BindException", "java.net.SocketException"),
    ("java.net.ConnectException", "java.net.SocketException"),
    ("java.net.ProtocolException", "java.io.IOException"),
    ("javax.jms.JMSException", "java.lang.Exception"),
    ("javax.ejb.EJBException", "java.lang.RuntimeException"),
    ("java.io.PrintWriter", "java.io.Writer"), ("java.io.BufferedWriter", "java.io.Writer"),
    ("java.io.OutputStreamWriter", "java.io.Writer"),
    ("java.io.FileWriter", "java.io.OutputStreamWriter"),
    ("java.io.PrintStream", "java.io.FilterOutputStream"),
    ("java.lang.Class", "java.lang.reflect.Type"), ("java.lang.reflect.ParameterizedType", "java.lang.reflect.Type"),
    ("com.opensymphony.xwork2.ActionSupport", "com.opensymphony.xwork2.Action"),
]
