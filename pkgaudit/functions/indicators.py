"""Threat indicators in source text: the catalogue and how matches are counted.

Each indicator is a regular expression with a weight. Running 68 expressions over every file is the
most expensive work of the audit, so each one is guarded by literals that any match must contain:
one pass finds the literals of a text, and an expression without its literals is skipped. The guards
never decide a match, so counts are exact.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Indicator(NamedTuple):
    name: str
    category: str
    weight: int
    pattern: str
    # What a match needs in the lower-cased text: one of these. A tuple needs all its parts;
    # text starting with 're:' is itself an expression.
    needs: tuple


NON_ASCII = "non-ascii"
HTTP = ("http://", "https://")
ENV = ("process.env", "os.environ")
TLDS = (".xyz", ".top", ".tk", ".ml", ".ga", ".cf", ".gq", ".pw", ".ru", ".su")

# Hosts whose addresses are not counted as external.
KNOWN_HOSTS = (
    r"localhost|127\.0\.0\.1|0\.0\.0\.0|registry\.npmjs\.org|github\.com|gitlab\.com|npmjs\.com|pypi\.org|"
    r"jfrog\.io|amazonaws\.com|docker\.io|docker\.com|googleapis\.com|cloudflare\.com|w3\.org|schema\.org|"
    r"spdx\.org|creativecommons\.org|opensource\.org|example\.com|json-schema\.org|xml\.org|ietf\.org|"
    r"swagger\.io|openapis\.org|microsoft\.com|apple\.com|google\.com|mozilla\.org"
)
ADDRESS = r"[a-z0-9][-a-z0-9.]*\.[a-z]{2,}"

# The indicator catalogue (name, category, weight, expression), in report order.
INDICATORS = (
    Indicator("http-request-api", "network", 2,
              r"(?i)https?\.request\s*\(\s*\{|https?\.get\s*\(|urllib\.request|requests\.(get|post|put)\s*\(",
              (".request", "requests.", "http.get", "https.get")),
    Indicator("http-post-data", "network", 3,
              r"""(?i)method:\s*['"]POST['"]|\.write\s*\(\s*(JSON\.stringify|payload|data|encoded|body)""",
              ("method:", ".write")),
    Indicator("curl-wget-nc", "network", 3, r"(?i)\bcurl\s|wget\s|netcat\s|\bnc\s+-[elzw]",
              ("curl", "wget", "netcat", r"re:nc\s+-[elzw]")),
    Indicator("fetch-xhr", "network", 1, r"(?i)\bfetch\s*\(|XMLHttpRequest|axios\.(get|post)\(",
              ("fetch", "xmlhttprequest", "axios.")),
    Indicator("socket-connect", "network", 3,
              r"(?i)net\.createConnection|net\.connect\(|socket\.connect\(|new\s+WebSocket\(",
              ("net.createconnection", "net.connect(", "socket.connect(", "websocket(")),
    Indicator("socket-import", "network", 2,
              r"""(?i)import\s+socket|require\s*\(\s*['"]net['"]\)|from\s+['"]net['"]""",
              ("socket", "net'", 'net"')),
    Indicator("dns-exfil", "network", 3, r"(?i)dns\.resolve|dns\.lookup|\.resolveAny|\.resolveTxt",
              ("dns.", ".resolveany", ".resolvetxt")),
    Indicator("external-url", "network", 0, rf"(?i)https?://(?!{KNOWN_HOSTS}){ADDRESS}", HTTP),
    Indicator("known-c2", "network", 6,
              r"(?i)models\.litellm\.cloud|checkmarx\.zone|pastebin\.com/raw|transfer\.sh|ngrok\.io|requestbin|"
              r"pipedream|oastify\.com|oast\.fun|oast\.pro|oast\.me|oast\.site|interactsh\.com|burpcollaborator|"
              r"canarytokens|resolver-io\.net",
              ("models.litellm.cloud", "checkmarx.zone", "pastebin.com/raw", "transfer.sh", "ngrok.io", "requestbin",
               "pipedream", "oast", "interactsh.com", "burpcollaborator", "canarytokens", "resolver-io.net")),
    Indicator("telegram-exfil", "network", 4,
              r"(?i)api\.telegram\.org|t\.me/|sendMessage.*chat_id|bot.*token.*telegram",
              ("telegram", "t.me/", ("sendmessage", "chat_id"))),
    Indicator("discord-webhook", "network", 4,
              r"(?i)discord\.com/api/webhooks|discordapp\.com/api/webhooks", ("/api/webhooks",)),
    Indicator("suspicious-tld", "network", 2,
              r"""(?i)https?://[^\s'"]+\.(xyz|top|tk|ml|ga|cf|gq|pw|ru|su)[/'"\\s]""",
              tuple((scheme, tld) for scheme in HTTP for tld in TLDS)),
    Indicator("metadata-endpoint", "network", 4,
              r"(?i)169\.254\.169\.254|metadata\.google\.internal|metadata\.azure\.com",
              ("169.254.169.254", "metadata.google.internal", "metadata.azure.com")),
    Indicator("credential-files", "creds", 4,
              r"(?i)\.ssh/id_rsa|\.ssh/id_ed25519|\.aws/credentials|\.kube/config|\.docker/config\.json|\.npmrc|"
              r"\.netrc|\.gnupg|\.pgpass|bash_history|zsh_history|\.config/gcloud|\.azure/credentials",
              (".ssh/id_", ".aws/credentials", ".kube/config", ".docker/config.json", ".npmrc", ".netrc", ".gnupg",
               ".pgpass", "sh_history", ".config/gcloud", ".azure/credentials")),
    Indicator("system-files", "creds", 4, r"(?i)/etc/shadow|/etc/passwd|/etc/hosts", ("/etc/",)),
    Indicator("homedir-read", "creds", 3,
              r"(?i)homedir\(\).*readFile|os\.homedir\(\).*readFile|expanduser.*open|Path\.home\(\)",
              ("homedir()", "expanduser", "path.home()")),
    Indicator("crypto-wallets", "crypto", 4,
              r"(?i)\.bitcoin/|\.ethereum/|\.solana/|wallet\.dat|keystore/|\.electrum/|\.monero/|\.exodus/",
              (".bitcoin/", ".ethereum/", ".solana/", "wallet.dat", "keystore/", ".electrum/", ".monero/", ".exodus/")),
    Indicator("seed-mnemonic", "crypto", 3,
              r"(?i)mnemonic|seed.?phrase|bip39|bip44|recovery.?phrase|secret.?recovery",
              ("mnemonic", "phrase", "bip39", "bip44", "recovery")),
    Indicator("browser-wallets", "crypto", 4,
              r"(?i)metamask|phantom|solflare|nkbihfbeogaeao|chrome.*extensions.*wallet",
              ("metamask", "phantom", "solflare", "nkbihfbeogaeao", ("extensions", "wallet"))),
    Indicator("env-bulk-dump", "env", 4,
              r"(?i)JSON\.stringify\([^)]*process\.env|JSON\.stringify\([^)]*os\.environ|"
              r"JSON\.stringify\(\{[^}]*env:\s*process\.env", ENV),
    Indicator("env-iterate-all", "env", 3,
              r"(?i)Object\.(keys|entries|values)\(\s*process\.env\s*\)|Object\.fromEntries\([^)]*process\.env|"
              r"for\s*\(\s*\w+\s+in\s+process\.env\)|os\.environ\.items\(\)|os\.environ\.copy\(\)|"
              r"for\s+\w+\s+in\s+os\.environ", ENV),
    Indicator("env-filter-pattern", "env", 4,
              r"(?i)process\.env\)\.filter\(|Object\.\w+\(process\.env\)\.filter", ("process.env",)),
    Indicator("env-regex-secrets", "env", 4,
              r"(?i)/(TOKEN|KEY|SECRET|PASS|CRED).*/[gimsuy]*\.test\s*\(", (".test",)),
    Indicator("env-spread-into-payload", "env", 4,
              r"(?i)\.\.\.\s*process\.env|env:\s*process\.env|env:\s*\{[^}]*\.\.\.process\.env|"
              r'"env"\s*:\s*process\.env', ("process.env",)),
    Indicator("env-reduce-collect", "env", 3,
              r"(?i)\.reduce\([^)]*process\.env|Object\.assign\([^)]*process\.env", ("process.env",)),
    Indicator("env-printenv", "env", 3, r"(?i)printenv|set\s*\|\s*grep|env\s*\|\s*grep|export\s+-p",
              ("printenv", "grep", "export")),
    Indicator("env-secrets-named", "env", 1,
              r"(?i)AWS_SECRET_ACCESS_KEY|AWS_SESSION_TOKEN|GITHUB_TOKEN|NPM_TOKEN|ARTIFACTORY_CREDS|OPENAI_API_KEY|"
              r"STRIPE_SECRET_KEY|SLACK_TOKEN|DATABASE_URL|VAULT_TOKEN",
              ("_token", "aws_secret_access_key", "artifactory_creds", "openai_api_key", "stripe_secret_key",
               "database_url")),
    Indicator("dynamic-exec", "exec", 3,
              r"(?i)new\s+Function\s*\(|eval\s*\((?!uate)|exec\s*\([^)]*(?:\.toString|base64|decode|atob|compile)",
              ("eval", "exec", ("function", r"re:new\s+function"))),
    Indicator("subprocess-launch", "exec", 2,
              r"(?i)subprocess\.(?:Popen|run|call|check_output|check_call)\s*\(|os\.(?:system|popen)\s*\(",
              ("subprocess.", "os.system", "os.popen")),
    Indicator("base64-decode-exec", "exec", 3,
              r"""(?i)Buffer\.from\([^)]+,\s*['"]base64['"]\)\s*\.toString|atob\s*\(|base64\.b64decode|"""
              r"base64\.decode|b64decode\s*\(", ("base64", "atob", "b64decode")),
    Indicator("marshal-pickle", "exec", 3,
              r"(?i)marshal\.loads|pickle\.loads|dill\.loads|cPickle\.loads|yaml\.load\([^)]*Loader",
              (".loads", "yaml.load(")),
    Indicator("dynamic-import", "exec", 2,
              r"""(?i)__import__\s*\(|importlib\.import_module|require\s*\(\s*[^'"]""",
              ("__import__", "importlib.import_module", "require")),
    Indicator("python-pip-install", "exec", 4,
              r"(?i)\bpip\s+install\b|\bpip3\s+install\b|subprocess.*pip.*install", (("pip", "install"),)),
    Indicator("python-codecs-decode", "exec", 4,
              r"""(?i)codecs\.decode\s*\([^)]*['"]rot.?13['"]|codecs\.decode\s*\([^)]*['"]hex""", ("codecs.decode",)),
    Indicator("python-compile-exec", "exec", 4,
              r"(?i)compile\s*\([^)]+\)\s*\n?\s*exec\s*\(|exec\s*\(\s*compile\s*\(", (("compile", "exec"),)),
    Indicator("python-setup-override", "install", 3,
              r"""(?i)setuptools\.command\.install|cmdclass\s*=\s*\{[^}]*['"]install['"]|"""
              r"setuptools\.command\.develop", ("setuptools.command.", "cmdclass")),
    Indicator("python-pty-spawn", "exec", 5, r"(?i)pty\.spawn\s*\(", ("pty.spawn",)),
    Indicator("python-os-system", "exec", 2, r"(?i)os\.system\s*\(|os\.popen\s*\(", ("os.system", "os.popen")),
    Indicator("python-socket-connect", "network", 3,
              r"(?is)socket\.socket\s*\([^)]*\)[\s\S]{0,200}\.connect\s*\(|socket\.create_connection\s*\(",
              ("socket.socket", "socket.create_connection")),
    Indicator("python-urllib", "network", 2,
              r"(?i)urllib\.urlopen|urllib2\.urlopen|urllib\.request\.urlopen|urlopen\s*\(", ("urlopen",)),
    Indicator("python-http-client", "network", 2, r"(?i)HTTPSConnection\s*\(|HTTPConnection\s*\(|http\.client",
              ("httpsconnection", "httpconnection", "http.client")),
    Indicator("string-concat-hide", "exec", 3,
              r"""(?i)\.join\s*\(\s*['"]['"]?\s*\).*require|\.join\s*\(\s*['"]['"]?\s*\).*https?""", (".join",)),
    Indicator("hex-base64-blob", "exec", 3, r"(?i)[A-Za-z0-9+/=]{200,}|\\x[0-9a-f]{2}(\\x[0-9a-f]{2}){20,}",
              (r"re:(?<![a-z0-9+/=])[a-z0-9+/=]{200}", "\\x")),
    Indicator("chr-obfuscation", "exec", 4,
              r'(?i)map\s*\(\s*chr\s*,|join\s*\(\s*map\s*\(\s*chr|""\s*\.join\s*\(\s*\[chr|'
              r"String\.fromCharCode\s*\(\s*\d+\s*(,\s*\d+\s*){3,}",
              (("map", "chr"), ("join", "chr"), "string.fromcharcode")),
    Indicator("exec-chr-combo", "exec", 5,
              r"""(?i)exec\s*\(\s*["']?\s*["']?\s*\.?\s*join\s*\(\s*map\s*\(\s*chr""", (("exec", "join", "chr"),)),
    Indicator("encoded-powershell", "exec", 4,
              r"(?i)powershell.*-[Ee]ncoded[Cc]ommand|FromBase64String|System\.Convert",
              ("-encodedcommand", "frombase64string", "system.convert")),
    Indicator("child-process", "exec", 2,
              r"""(?i)require\s*\(\s*['"]child_process['"]\)|child_process\.exec|execSync\s*\(|spawnSync\s*\(""",
              ("child_process", "execsync", "spawnsync")),
    Indicator("discord-token-steal", "creds", 5,
              r"(?i)Discord.*token|token.*Discord|isValidDiscordToken|extractAllTokens|discord.*leveldb",
              ("discord", "extractalltokens")),
    Indicator("install-script", "install", 3,
              r"""(?i)["']?preinstall["']?\s*:|["']?postinstall["']?\s*:|["']?preuninstall["']?\s*:""",
              ("preinstall", "postinstall", "preuninstall")),
    Indicator("build-injection", "install", 3,
              r"(?is)BannerPlugin|DefinePlugin.*process\.env|webpack.*plugin.*raw|prepend.*main\.js|"
              r"\.to\s*\(.*main\.js", ("bannerplugin", ("defineplugin", "process.env"), ("webpack", "raw"), "main.js")),
    Indicator("ci-workflow-write", "cicd", 4,
              r"(?i)writeFile.*\.github/workflows|writeFile.*\.gitlab-ci|writeFile.*\.circleci|"
              r"writeFile.*\.travis\.yml|writeFile.*azure-pipelines|fs\.write.*workflow", ("writefile", "fs.write")),
    Indicator("ci-tool-exec", "cicd", 2,
              r"(?i)terraform\s+(show|apply|plan)|kubectl\s+(apply|exec|create)|helm\s+(install|upgrade)",
              ("terraform", "kubectl", "helm")),
    Indicator("proc-docker-access", "cicd", 4, r"(?i)/proc/\d+/mem|/var/run/docker\.sock|docker\.sock",
              ("/proc/", "docker.sock")),
    Indicator("shell-profile", "persist", 4, r"(?i)\.bashrc|\.zshrc|\.bash_profile|\.profile|\.zprofile",
              (".bashrc", ".zshrc", ".bash_profile", ".profile", ".zprofile")),
    Indicator("system-persist", "persist", 4,
              r"(?i)crontab|launchctl\s+load|systemctl\s+enable|systemd.*service|\.pth|Library/LaunchAgents|"
              r"HKEY_(?:LOCAL_MACHINE|CURRENT_USER)|reg(?:\.exe)?\s+add",
              ("crontab", "launchctl", "systemctl", "systemd", ".pth", "library/launchagents", "hkey_",
               ("add", r"re:reg(?:\.exe)?\s+add"))),
    Indicator("archive-encrypt", "data-pkg", 3,
              r"(?i)tar\s+[a-z]*c[a-z]*f|openssl\s+enc|gpg\s+--encrypt|zip\s+-[er]",
              ("openssl", "--encrypt", r"re:tar\s+[a-z]*c[a-z]*f", ("zip", r"re:zip\s+-[er]"))),
    Indicator("known-artifacts", "data-pkg", 4,
              r"(?i)tpcp\.tar\.gz|payload\.enc|\.tar\.gz.*/tmp|/tmp.*\.tar\.gz", (".tar.gz", "payload.enc")),
    Indicator("monkey-patch", "hook", 4,
              r"(?i)module\.constructor\.prototype|Module\._resolveFilename|Module\._load|__proto__.*require",
              ("module.constructor", "module._", "__proto__")),
    Indicator("prototype-pollute", "hook", 3, r"(?i)Object\.prototype\[|__proto__\s*=",
              ("object.prototype[", "__proto__")),
    Indicator("timebomb-date", "timebomb", 3,
              r"(?i)new\s+Date\(\)\.getFullYear\(\)\s*[><=!]+\s*\d{4}|"
              r"Date\.now\(\)\s*[><=!]+\s*(?:\d{13}|[A-Z_]{4,})|const\s+[A-Z_]{4,}\s*=\s*1[5-9]\d{11}",
              ("getfullyear", "date.now", ("const", r"re:=\s*1[5-9]\d{11}"))),
    Indicator("timebomb-delay", "timebomb", 3,
              r"(?i)setTimeout\s*\([^,]+,\s*\d{6,}\)|setInterval\s*\([^,]+,\s*\d{6,}\)", ("settimeout", "setinterval")),
    Indicator("conditional-os", "timebomb", 3,
              r"""(?is)(?:process\.platform|os\.platform\(\))\s*===?\s*['"](win32|linux|darwin)['"][\s\S]{0,300}exec|"""
              r"""os\.name\s*==\s*['"](nt|posix)['"][\s\S]{0,300}subprocess""",
              ("process.platform", "os.platform()", "os.name")),
    Indicator("unicode-bidi", "trojan-source", 4,
              r"[\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\u200f\u061c]", (NON_ASCII,)),
    Indicator("zero-width-chars", "trojan-source", 4, r"[\u200b\u200c\u200d\ufeff\u2060]", (NON_ASCII,)),
    Indicator("eval-on-response", "loader", 4,
              r"(?i)eval\s*\(\s*(response|data|payload|result|body|text|res|chunk)\b", ("eval",)),
    Indicator("write-then-exec", "loader", 4,
              r"(?is)writeFile(?:Sync)?\s*\([^)]+\)[\s\S]{0,200}exec(?:Sync)?\s*\(|"
              r"writeFile(?:Sync)?\s*\([^)]+\)[\s\S]{0,200}require\s*\(",
              (("writefile", "exec"), ("writefile", "require"))),
    Indicator("multi-stage-fetch-exec", "loader", 4,
              r"(?is)(?:fetch|axios\.get|axios\.post|request)\s*\([^)]+\)[\s\S]{0,300}exec(?:Sync)?\s*\(",
              (("fetch", "exec"), ("axios.", "exec"), ("request", "exec"))),
    Indicator("metadata-private-ip", "network", 4,
              r'(?i)"(?:bugs|funding|homepage)"[^}]{0,100}'
              r"(?:192\.168\.|10\.\d+\.|172\.(?:1[6-9]|2\d|3[01])\.|127\.0\.0\.1|0\.0\.0\.0)",
              ('"bugs"', '"funding"', '"homepage"')),
)

# White space as the catalogue means it: more than the regular expressions of the JVM take \s for.
SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def jvm_pattern(pattern: str) -> str:
    """The catalogue's expression for the JVM.

    White space is widened to Unicode. An open-ended repeat of a group of varying length is cut to
    its minimum: the JVM recurses once per repeat, and the list it stands in goes on without a new match.
    """
    pattern = pattern.replace(r"(,\s*\d+\s*){3,}", r"(?:,\s*\d+\s*){3}")

    def widen(found: re.Match) -> str:
        text = found.group(0)
        if text == r"[^\s":
            return "[^" + SPACES
        return "[" + SPACES + "]" if text == r"\s" else text

    return re.sub(r"\\\\|\[\\s\\S\]|\[\^\\s|\\s", widen, pattern)


def _literals(needs: tuple) -> set[str]:
    found: set[str] = set()
    for need in needs:
        if isinstance(need, tuple):
            found |= _literals(need)
        elif need != NON_ASCII and not need.startswith("re:"):
            found.add(need)
    return found


GROUP = 8
LITERALS = sorted(set().union(*[_literals(i.needs) for i in INDICATORS]))


def literal_pattern(literals: list[str]) -> str:
    """An expression that, at every position of a text, captures the longest literal starting there.

    Shared beginnings are factored out and long lists of branches are grouped by their first character,
    so a position that starts no literal fails after a few tests. The first three characters are tested against
    those that literals have there before any branch is tried.
    """
    tree: dict = {}
    for word in literals:
        node = tree
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def text(node: dict) -> str:
        chars = sorted(c for c in node if c)
        if not chars:
            return ""
        parts = [re.escape(c) + text(node[c]) for c in chars]
        if len(parts) > GROUP:
            parts = [
                f"(?=[{re.escape(''.join(chars[i:i + GROUP]))}])(?:{'|'.join(parts[i:i + GROUP])})"
                for i in range(0, len(parts), GROUP)
            ]
        body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
        return f"(?:{body})?" if "" in node else body

    long = [word for word in literals if len(word) >= 3]
    leads = ["".join(f"[{re.escape(''.join(sorted({word[i] for word in long})))}]" for i in range(3))] if long else []
    leads += [re.escape(word) for word in literals if len(word) < 3]
    return f"(?={'|'.join(leads)})(?=({text(tree)}))"


def literals_in(lowered: Column) -> Column:
    """The guard literals a lower-cased text contains, from one pass over it."""
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(literal_pattern(LITERALS)), F.lit(1)))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _guard(needs: tuple, content: str, lowered: str, found: str) -> str:
    """SQL condition for what a match needs. A literal counts as found with any longer one it begins."""
    plain = [n for n in needs if isinstance(n, str) and n != NON_ASCII and not n.startswith("re:")]
    longer = sorted({w for n in plain for w in LITERALS if w.startswith(n)})
    parts = [f"arrays_overlap({found}, array({', '.join(map(_quoted, longer))}))"] if plain else []
    for need in needs:
        if isinstance(need, tuple):
            parts.append("(" + " and ".join(_guard((n,), content, lowered, found) for n in need) + ")")
        elif need == NON_ASCII:
            parts.append(f"octet_length({content}) <> char_length({content})")
        elif need.startswith("re:"):
            parts.append(f"{lowered} rlike {_quoted(jvm_pattern(need[3:]))}")
    return "(" + " or ".join(parts) + ")"


def match_counts(content: str, lowered: str, found: str) -> Column:
    """Indicators that match a text, in catalogue order, each with its number of matches.

    Takes the names of the text, lower-cased text and found literals columns.
    """
    entries = [
        f"case when {_guard(i.needs, content, lowered, found)} then named_struct('name', {_quoted(i.name)}, "
        f"'category', {_quoted(i.category)}, 'weight', {i.weight}, "
        f"'count', regexp_count({content}, {_quoted(jvm_pattern(i.pattern))})) end"
        for i in INDICATORS
    ]
    return F.expr(f"filter(array({', '.join(entries)}), x -> x.count > 0)")
