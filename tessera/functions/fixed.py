"""Fixed values that results depend on: word lists, patterns and limits."""

# Substrings of file contents that count as authentication, in search ranking.
AUTH_WORDS = ["authenticate", "authorize", "login", "logout", "signin", "signout", "saml", "oauth", "jwt", "bearer", "claims", "identity", "principal", "certificate", "token", "session", "cookie", "credential"]
# Those that mark a chunk's type, beside the words above.
AUTH_TYPE_WORDS = ["[authorize]", "[authentication]", "authenticationhandler", "iauthorizationhandler", "authenticationscheme", "claimsprincipal"]
# Substrings of a method's content that raise its importance.
AUTH_METHOD_WORDS = ["authenticate", "authorize", "validatetoken", "signin", "signout", "login", "logout", "createtoken", "validatecredentials"]
# Substrings of contents that count as security.
SECURITY_WORDS = ["encryption", "decrypt", "hash", "salt", "cryptography", "certificate", "x509", "rsa", "aes", "hmac"]
# Parts of file names and of directories that count as authentication.
AUTH_FILE_WORDS = ["auth", "login", "security"]
AUTH_DIRECTORY_WORDS = ["identity", "auth", "security"]
# Parts of names of C functions and types, by the suffix they give.
C_NAME_WORDS = {
    "-auth": ["auth", "login", "password", "credential", "token", "session"],
    "-security": ["crypt", "hash", "encrypt", "decrypt", "secure", "key"],
    "-config": ["config", "setting", "option", "param"],
}

# Groups of search terms that stand for each other, in the order of registration.
SYNONYM_GROUPS = [
    ["auth", "authentication", "authorization", "login", "signin", "credential", "identity"],
    ["logout", "signout", "logoff"],
    ["token", "jwt", "bearer", "access token", "refresh token"],
    ["password", "pwd", "passphrase", "secret"],
    ["user", "account", "member", "identity", "principal"],
    ["permission", "privilege", "access", "role", "claim"],
    ["security", "secure", "encryption", "cryptography"],
    ["config", "configuration", "settings", "options", "preferences", "setup"],
    ["env", "environment", "environment variable"],
    ["param", "parameter", "argument", "arg"],
    ["init", "initialize", "initialise", "setup", "startup", "bootstrap"],
    ["create", "new", "instantiate", "construct"],
    ["start", "begin", "launch", "run"],
    ["stop", "end", "terminate", "shutdown", "dispose"],
    ["get", "fetch", "retrieve", "load", "read", "find", "query"],
    ["save", "store", "persist", "write", "insert", "create"],
    ["update", "modify", "change", "edit", "patch"],
    ["delete", "remove", "destroy", "drop", "clear"],
    ["search", "find", "lookup", "query", "filter"],
    ["api", "endpoint", "service", "rest", "web service"],
    ["request", "call", "invoke", "http request"],
    ["response", "result", "reply", "http response"],
    ["controller", "endpoint", "route", "action"],
    ["db", "database", "data store", "repository"],
    ["table", "entity", "model", "record"],
    ["query", "sql", "linq", "select"],
    ["connection", "connect", "connection string"],
    ["error", "exception", "fault", "issue", "problem"],
    ["log", "logger", "logging", "trace", "debug"],
    ["validate", "validation", "verify", "check"],
    ["async", "asynchronous", "await", "task"],
    ["sync", "synchronous", "blocking"],
    ["cache", "caching", "cached", "memory cache"],
    ["queue", "message queue", "mq", "messaging"],
    ["event", "event handler", "callback", "hook"],
    ["interface", "contract", "abstraction"],
    ["implement", "implementation", "concrete"],
    ["test", "unit test", "testing", "spec"],
    ["file", "document", "blob"],
    ["upload", "file upload", "attachment"],
    ["download", "export", "file download"],
    ["path", "filepath", "directory", "folder"],
]

# What a title's characters become in its alias; the first three words are kept.
ALIAS_TO_SPACE = ":/\\()[]{}.,;!?|"
ALIAS_DROPPED = "\"'$^*<>~`"
ALIAS_WORDS = {"@": "at", "#": "number", "%": "percent", "&": "and", "+": "plus", "=": "equals"}

# Paths that aren't indexed. dir/: a directory anywhere below the base; *suffix: a
# suffix, in any case; others: a part of the path. Larger files aren't indexed either.
IGNORED = ["bin/", "obj/", ".vs/", "packages/", "TestResults/", "*.dll", "*.exe", "*.pdb", "*.cache", "*.user", ".git/", "node_modules/", "dist/", "build/", "*.min.js", "*.min.css", "_ReSharper*/", "*.suo", "Migrations/", "Connected Services/"]
MAX_INDEXED_BYTES = 1024 * 1024
SOURCE_EXTENSIONS = ["cs", "razor", "cshtml", "c", "h"]

# Limits of chunks, in characters, and of overlaps.
TARGET_CHUNK = 10_000
ULTRA_CHUNK = 2_000
OVERLAP = 0.15
MAX_OVERLAP_LINES = 10

# A block-level HTML element at a line's start is a place to cut.
BLOCK_TAGS = ["div", "section", "article", "header", "footer", "main", "nav", "aside", "form", "table", "thead", "tbody", "tr", "fieldset", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6"]

# Patterns of lines (without outer white space) before which a window may end.
_CONTROL = r"^$|^//|^/\*|^\}$|^if \(|^else|^for \(|^while \(|^foreach \(|^switch \(|^case |^try|^catch|^finally"
BREAKS = {
    "method": _CONTROL + r"|^default:|^using \(|^var |^string |^int |^bool |^async |^await | = new |^return |^throw |^#region|^#endregion|TODO:|FIXME:|NOTE:",
    "ultra": r"^$|^//|^/\*|^\}$|;$|\{$|^if \(|^else|^case |^var |^string |^int |^return |\.| = ",
    "top_level": r"^$|^//|^/\*|^using |^var |^const |^static |;$|\{$|^\}|^if |^for |^foreach |^while |^switch |^try |^catch |^finally |builder\.|app\.|services\.",
    "file": r"^$|^//|^/\*|^using |^namespace |^public|^private |^protected |^internal |^class |^interface |^struct |^enum |^\}$|^#region|^#endregion",
    "razor": _CONTROL + r"|^\[Parameter\]|^\[Inject\]|^protected override|^public override|^private void|^public void|^private async|^public async",
    "html": r"^$|^<!--|^@\*|(?i:^</?(" + "|".join(BLOCK_TAGS) + r"))|^@if|^@else|^@for|^@while|^@switch|^@using|^@\{|^\}$|^@code|^@functions|^</?[A-Z]",
    "c": r"^$|^if |^else|^for |^while |^switch |^case |^break;|^continue;|^return|\(.*;$| = .*;$|\{$|^\}$|^//|^/\*|^\*|^#",
    "c_ultra": r"^$|^if |^else|^for |^while |^switch |^case |^break;|^continue;|^return|\{$|^\}$|^//|^/\*|^#|;$| = |\+\+|--|\(.*\)|\).*\(|\[.*\]|\].*\[|->|\*|&",
}
