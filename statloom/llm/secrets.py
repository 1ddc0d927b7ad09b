"""Problem 3: credentials embedded in source code and configuration.

Token formats, key armour and connection strings are one deterministic automaton: started where their first characters stand, it decides
and gives the span, however long.  Those first characters and the names of secrets are a second one, which scans overlapping chunks of all
texts; around a name, a grammar of assignments, calls and options decides.  Absolute spans are merged, and placeholders are spliced into them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statloom.llm.automaton import Automaton
from statloom.llm.common import texts_of

PLACEHOLDER = "<REDACTED>"
#: Characters of a line before and after a place that the grammar sees; lines up to LINE are seen whole.  What a piece cuts is added to it.
BEFORE, AFTER, LINE = 240, 700, 1500

# Words that name a secret when a name ends with them.  Fixed values.
_NAMES = (
    r"pass(?:word|wd|phrase|wort|code|_?key)|(?<![a-z0-9])(?:pass|pw|psw)|pwd|kennwort|contrase(?:n|ñ)a|senha|motdepasse|mot_de_passe|haslo|secret|token|bearer|"
    r"credentials?|(?:api|access|secret|private|signing|encryption|master|account|auth|client|shared|session|storage|subscription|x)[_-]?key|key[_-]?id|"
    r"x[_-]?auth|authorization|auth[_-]?token|private[_-]?token|secret[_-]?access[_-]?key|access[_-]?key[_-]?id"
)
#: The end of a name; its beginning is read backwards, so that a long run of word characters is not tried from each place.
_NAME = rf"(?:{_NAMES})\d{{0,2}}"
#: A whole name after a fixed character.
_WHOLE = rf"[\w.$:-]{{0,50}}?(?:{_NAMES})\d{{0,2}}"
_BEGIN = re.compile(r"[\w.$-]{0,60}$")

# Token formats.  Fixed values.
_TOKENS = [
    r"(?:AKIA|ASIA|AGPA|AIDA|AROA)[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{30,}", r"github_pat_[A-Za-z0-9_]{22,}", r"glpat-[A-Za-z0-9_-]{18,}",
    r"xox[abeoprs]-[A-Za-z0-9-]{10,}", r"(?:sk|rk|pk)_live_[A-Za-z0-9]{16,}", r"sk_test_[A-Za-z0-9]{16,}", r"AIza[A-Za-z0-9_-]{30,}", r"npm_[A-Za-z0-9]{30,}",
    r"dop_v1_[A-Za-z0-9]{30,}", r"hvs\.[A-Za-z0-9_-]{20,}", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", r"shp(?:at|ca|pa|ss)_[A-Za-z0-9]{28,}",
    r"pypi-[A-Za-z0-9_-]{30,}", r"hf_[A-Za-z0-9]{30,}", r"sk-[A-Za-z0-9_-]{32,}", r"pat-[A-Za-z0-9]{30,}", r"ya29\.[A-Za-z0-9_-]{20,}",
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{10,}",
]



def _name_anchors(names: str) -> str:
    """The names as a pattern of the automaton: a boundary is also the start of a line; what is not ASCII is any character that is no letter."""
    plain = names.replace("(?<![a-z0-9])", "(^|[^a-z0-9])").replace("(?:", "(")
    return re.sub(r"[^\x00-\x7f]", "[^a-z]", plain)


# The first characters of the token formats, and how many they are.  Fixed values.
_STARTS = {
    "(akia|asia|agpa|aida|aroa)[0-9a-z][0-9a-z]": 6, "gh[pousr]_[a-z0-9]": 5, "github_pat_": 11, "glpat-": 6, "xox[abeoprs]-": 5, "[srp]k_(live|test)_": 8, "aiza[a-z0-9_-]": 5, "npm_[a-z0-9]": 5, "dop_v1_": 7, "hvs\\.": 4,
    "sg\\.[a-z0-9_-]": 4, "shp(at|ca|pa|ss)_": 6, "pypi-": 5, "hf_[a-z0-9]": 4, "sk-[a-z0-9_-]": 4, "pat-": 4, "ya29\\.": 5, "eyj[a-z0-9_-]": 4,
}
# What tells key armour, an address with a login and a connection string, and the text that they begin with (an address: its scheme before).
_FORMATS = {"-----begin [a-z0-9 ]*private key": "-----BEGIN", "://[^ /@\"'<>]*:[^ /@\"'<>]": "://", ";[ \t]*(password|pwd)[ \t]*=": ";"}
_SCHEME = re.compile(r"(?i)\b[a-z][a-z0-9+.-]*\Z")


@lru_cache(maxsize=1)
def formats() -> Automaton:
    """The automaton of whole credentials: the token formats, then armour, address and connection string."""
    blank = " \t\r\x0b\x0c"
    word = lambda w: "".join(f"[{c}{c.upper()}]" for c in w)
    return Automaton([
        *(t.replace("(?:", "(") for t in _TOKENS), "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY( BLOCK)?-----", f"[A-Za-z][A-Za-z0-9+.-]*://[^{blank}/@:\"'`<>]*:[^{blank}/@\"'`<>]+@",
        f";[{blank}]*({word('password')}|{word('pwd')})[{blank}]*=[{blank}]*[^;\"'<>{blank}]+",
    ], restart=False, cased=True)


_ANCHORS = [
    _name_anchors(_NAMES), "(x|api)-[a-z0-9_-]*(key|auth)", "basic[\"']?[ \t]*[, +]",
    "identified[ \t]+by", "(-u|--user)[ =]", "mysql", "mariadb", "sshpass", "sudo[ \t]+-s", "(login|connect|authenticate|sign_?in|logon)[ \t]*\\(", "log[io]n[ \t]+[^ ]",
    *_STARTS, *_FORMATS,
    # signed addresses
    "[?&](sig|signature|token|access_token|auth|key|api_key|apikey|code|x-amz-signature|x-goog-signature)=",
]


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton(_ANCHORS)


_Q = r"\"'`"
# a literal in quotes; a second group for pieces that are joined
_LITERAL = rf"(?:[rbuf]{{0,2}})(?P<q>[{_Q}])(?P<v>(?:(?!(?P=q)|\\n)[^\\]|\\.)*)(?P=q)"
_SET = r"(?:<<-|<-|:=|=>|=|:)"
_LOOKED_UP = r"(?:(?:process\.env|os\.environ|env)[\w.\[\]\"'()]*\s*(?:\|\||\?\?|or)\s*)?"
_CALL = r"(?:(?:paste0?|c|String|str|bytes|b64decode|base64\.b64decode|atob|Buffer\.from|unhex|sprintf|strdup|std::string|new String)\s*\(\s*){0,2}"

_GRAMMAR = {
    "named": re.compile(rf"(?i)(?P<name>{_NAME})[\"'`\])]*\s*{_SET}\s*{_LOOKED_UP}{_CALL}{_LITERAL}"),
    "bare": re.compile(rf"(?i)(?P<name>{_NAME})[\"'`\]]*(?:\s*(?:=>|=|:(?!:))\s*|\s*<-\s*)(?P<v>[^\s\"'`,;<>(){{}}\[\]]+)(?P<rest>[^\n]*)"),
    "spaced": re.compile(rf"(?i)(?P<name>{_NAME})\s+(?:is\s+|by\s+|of\s+)?{_LITERAL}"),
    "called": re.compile(rf"(?i)(?P<name>{_NAME})\s*\(\s*{_LITERAL}"),
    "word": re.compile(rf"(?i)(?P<name>{_NAME})\s+(?P<v>[^\s\"'`,;<>(){{}}\[\]=]+)"),
    "by": re.compile(rf"(?i)\b(?P<name>identified\s+by|password)\s+{_LITERAL}"),
    "netrc": re.compile(r"(?i)\blogin\s+\S+\s+(?P<name>password)\s+(?P<v>\S+)"),
    "option": re.compile(rf"(?i)--(?P<name>{_WHOLE})[\"']?(?:\s+|=|,\s*(?:default\s*=\s*|help\s*=[^,]*,\s*default\s*=\s*)?)(?:{_LITERAL}|(?P<v2>[^\s\"'`,;<>(){{}}\[\]]+))"),
    "tagged": re.compile(rf"(?i)<(?:[\w:.-]+\s+)*(?:[\w:.-]*(?:name|key|id)\s*=\s*[\"'])?(?P<name>{_WHOLE})[\"']?[^<>]{{0,40}}?>(?P<v>[^<>]+)<"),
    "attribute": re.compile(rf"(?i)[\"'](?P<name>{_WHOLE})[\"']\s*,?\s*[\"']?value[\"']?\s*[:=]\s*{_LITERAL}"),
    "pair": re.compile(rf"(?i)[\"'](?P<name>{_WHOLE})[\"']\s*,\s*{_LITERAL}"),
    "reversed": re.compile(rf"(?i){_LITERAL}\s*->>?\s*(?P<name>{_WHOLE})\b"),
    "bearer": re.compile(r"(?i)\b(?P<name>bearer|basic)[\"']?\s*[, +]\s*[\"']?(?P<v>[A-Za-z0-9._~+/-]{8,}=*)"),
    "header": re.compile(rf"(?i)\b(?P<name>(?:x|api)-[\w-]*(?:key|auth|token|secret)|authorization)[\"']?\s*[:=]\s*[\"']?(?:(?:token|bearer|basic|apikey)\s+)?(?P<v>[A-Za-z0-9._~+/=-]{{8,}})"),
    "signed": re.compile(r"(?i)://[^\s\"'`<>]+?[?&](?P<name>sig|signature|token|access_token|auth|key|api_key|apikey|code|x-amz-signature|x-goog-signature)=(?P<v>[^\s\"'`<>&]{8,})"),
    "curl": re.compile(r"(?i)(?:\s-u|--user)[ =][\"']?(?P<u>[^\s:\"'$]+):(?P<v>[^\s\"']+)"),
    "client": re.compile(rf"(?i)\b(?:mysql\w*|mariadb\w*|sshpass)\b[^\n|;]*?\s-p\s?(?:{_LITERAL}|(?P<v2>[^\s\"']+))"),
    "sudo": re.compile(rf"(?i)\becho\s+(?:-n\s+)?(?:{_LITERAL}|(?P<v2>[^\s\"'|]+))\s*\|\s*sudo\s+-S"),
    "login": re.compile(rf"(?i)\b(?:login|connect|authenticate|sign_?in|logon)\s*\(\s*(?:[\"'][^\"']*[\"']\s*,\s*){{1,2}}{_LITERAL}\s*\)"),
    "slash": re.compile(r"(?i)\blog[io]n\s+\S+\s+/\s+(?P<v>\S+)"),
}
_BACKWARDS = frozenset(["named", "bare", "spaced", "called", "word"])
_MORE = re.compile(rf"\s*(?:\+|\.\.|\.|,|&|\|\||\\)?\s*[{_Q}](?P<v>[^{_Q}\n]*)[{_Q}]")

# What the end of a piece of a line cuts.  A literal that is open there, after all that the grammar wants before it:
_OPEN = rf"(?:[rbuf]{{0,2}})(?P<q>[{_Q}])(?:(?!(?P=q))[^\\]|\\.)*\\?\Z"
_OPEN_LITERALS = [
    re.compile(_GRAMMAR[k].pattern.partition(_LITERAL)[0] + _OPEN + ")" * (k in ("option", "client", "sudo")))
    for k in ("named", "spaced", "called", "by", "attribute", "pair", "login", "option", "client", "sudo")
]
#: Values without quotes that run up to the end.
_OPEN_VALUES = [
    re.compile(rf"(?i){_NAME}[\"'`\]]*(?:\s*(?:=>|=|:(?!:))\s*|\s*<-\s*|\s+)[^\s\"'`,;<>(){{}}\[\]]+\Z"), re.compile(rf"(?i)--{_WHOLE}[\"']?(?:\s+|=)[^\s\"'`,;<>(){{}}\[\]]+\Z"),
    re.compile(r"(?i)\blogin\s+\S+\s+(?:password\s+|/\s+)\S+\Z"), re.compile(r"(?i)\b(?:bearer|basic)[\"']?\s*[, +]\s*[\"']?[A-Za-z0-9._~+/=-]+\Z"),
    re.compile(r"(?i)\b(?:(?:x|api)-[\w-]*(?:key|auth|token|secret)|authorization)[\"']?\s*[:=]\s*[\"']?(?:(?:token|bearer|basic|apikey)\s+)?[A-Za-z0-9._~+/=-]+\Z"),
    re.compile(r"(?i)[?&](?:sig|signature|token|access_token|auth|key|api_key|apikey|code|x-amz-signature|x-goog-signature)=[^\s\"'`<>&]+\Z"),
    re.compile(r"(?i)(?:\s-u|--user)[ =][\"']?[^\s:\"'$]+:[^\s\"']+\Z"), re.compile(r"(?i)\b(?:mysql\w*|mariadb\w*|sshpass)\b[^\n|;]*?\s-p\s?[^\s\"']+\Z"),
]
_OPEN_TAG = re.compile(rf"(?i)<(?:[\w:.-]+\s+)*(?:[\w:.-]*(?:name|key|id)\s*=\s*[\"'])?{_WHOLE}[\"']?[^<>]{{0,40}}?>[^<>]*\Z")
_RUN = re.compile(r"[^\s\"'`<>]*")
#: After a literal: a further piece that may be joined to it is cut.
_OPEN_MORE = re.compile(rf"[{_Q}]\s*(?:\+|\.\.|\.|,|&|\|\||\\)?\s*(?:[{_Q}][^{_Q}\n]*)?\Z")
# What the start of a piece cuts: the literal before a name or a command, the address before a signature.
_LITERAL_BEFORE = re.compile(rf"(?i)(?P<q>[{_Q}])(?:\s*->>?\s*{_WHOLE}\b|\s*\|\s*sudo\s+-S)")
_QUOTES = re.compile(rf"\\.|[{_Q}]")
_ADDRESS_BREAK = re.compile(r"[\s\"'`<>]")

# The lines of a key block.
_KEY_LINE = re.compile(
    r"(?:\\[nrt]|[\s\"'`,;>|*#&().\\-]|\+(?=\s*[\"'`])|//(?=\s))*(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset):[^\n\\\"']*|[A-Za-z0-9+/=]{24,}|"
    r"[A-Za-z0-9+/]{1,23}={1,2}(?![A-Za-z0-9])|(?=[A-Za-z]*[0-9+/]|[a-z]+[A-Z]|[A-Z]+[a-z]+[A-Z])[A-Za-z0-9+/]{4,23}(?=\s*$|\s*\n|\\[nr]|[\"'`]))"
)


def _key_end(text: str, at: int) -> int:
    """Where a key block ends whose body begins at a place: at its END mark, or, without one, after its last line of key data."""
    stop = text.find("-----END", at)
    if stop >= 0 and text.find("-----BEGIN", at, stop) < 0:
        return stop
    while m := _KEY_LINE.match(text, at):
        at = m.end()
    return at


class _LongLine:
    """A line of which only pieces are looked at."""

    def __init__(self, text: str, begin: int, end: int):
        self.text, self.begin, self.end = text, begin, end
        self._quotes: dict[str, list[int]] | None = None
        self._addresses: list[int] | None = None

    def quotes(self, kind: str) -> list[int]:
        """Where quote marks of a kind stand that are not escaped."""
        if self._quotes is None:
            self._quotes = {q: [] for q in _Q.replace("\\", "")}
            for m in _QUOTES.finditer(self.text, self.begin, self.end):
                if m.end() - m.start() == 1:
                    self._quotes[m.group()].append(m.start())
        return self._quotes[kind]

    def close(self, kind: str, at: int) -> int | None:
        """The end of a literal, and of those joined to it, that is open at a place."""
        marks = self.quotes(kind)
        k = bisect_left(marks, at)
        return self.joined(marks[k] + 1) if k < len(marks) else None

    def joined(self, at: int) -> int:
        while (m := _MORE.match(self.text, at, self.end)) and m.start("v") - at < 8:
            at = m.end()
        return at

    def piece(self, p: int) -> tuple[int, int]:
        """The piece around a place, with the whole of each literal, value or token that its ends would cut."""
        text, lo, hi = self.text, max(self.begin, p - BEFORE), min(self.end, p + AFTER)
        first = lo
        if lo > self.begin:
            for m in _LITERAL_BEFORE.finditer(text, lo, hi):
                marks = self.quotes(m.group("q"))
                k = bisect_left(marks, m.start())
                if k and k < len(marks) and marks[k] == m.start():
                    first = min(first, max(self.begin, marks[k - 1] - 3))
            if text[p] == "=":
                if self._addresses is None:
                    self._addresses = [m.start() for m in re.finditer("://", text[self.begin:self.end])]
                k = bisect_left(self._addresses, p - self.begin) - 1
                if k >= 0 and not _ADDRESS_BREAK.search(text, a := self._addresses[k] + self.begin, p):
                    first = min(first, max(self.begin, a - 40))
        if hi == self.end:
            return first, hi
        piece, last = text[lo:hi], hi
        for pattern in _OPEN_LITERALS:
            for m in pattern.finditer(piece):
                if (stop := self.close(m.group("q"), hi)) is not None:
                    last = max(last, stop)
        if any(x.search(piece) for x in _OPEN_VALUES):
            last = max(last, _RUN.match(text, hi, self.end).end())  # type: ignore[union-attr]
        if _OPEN_TAG.search(piece) and (stop := text.find("<", hi, self.end)) >= 0:
            last = max(last, stop + 1)
        # literals that are joined to one inside the piece
        for kind in ("named", "called"):
            for m in _GRAMMAR[kind].finditer(piece):
                to = m.end()
                while (more := _MORE.match(piece, to)) and more.start("v") - to < 8:
                    to = more.end()
                if _OPEN_MORE.match(piece, to - 1):
                    last = max(last, self.joined(lo + to))
        # what may have to follow a literal
        return first, min(self.end, last + 2) if last > hi else hi


_EMPTY = re.compile(
    r"(?i)^(?:[x*.\-_#?0\s]*|<.*>?|\$.*|%[\w.-]+%|%[sd]|\{\{?.*|\[.*\]|@.*@|#\{.*|.*\$\{.*|.*\{\{.*|.*<[a-z_ -]+>.*|!(?:ref|vault|secret|env|include|sub|getatt|importvalue)\b.*|"
    r"(?:todo|tbd|fixme|change[_ -]?(?:me|it)|none|null|nil|true|false|undefined|redacted|removed|hidden|masked|placeholder|n/?a|unset|empty|default|example|dummy|string|text|required|optional)|"
    r"(?:todo|tbd|fixme)\b.*|(?:insert|replace|enter|your|change|put|add)[_ -].*|my[_-]?(?:secret|token|password|key)\w*|.*(?:_|\b)(?:here|goes)|.*\.\.\..*|.*x{6,}.*|.*\*{4,}.*|.*example.*key.*)$"
)
_LOOKUP = re.compile(r"(?i)(?:getenv|\benviron\b|process\.env|\bsecrets\.|keyring\.|get_secret|os\.env|ENV\[|getpass\(|readline\(|arn:aws)")
_SECRET_WORD = re.compile(rf"(?i)^(?:[\w.-]*[_.-])?(?:{_NAMES})$")
_IDENT = re.compile(r"^[A-Za-z_][A-Za-z_]*(?:[._][A-Za-z_]+)*\d{0,3}$")
_ID_NAME = re.compile(r"(?i)(?:public|pub|primary|foreign|sort|partition|object|cache|row|hash|check)[_-]?key|key[_-]?(?:name|path|file|words?|board)|(?:^|_)(?:next|page|cursor|csrf|cancel\w*)_?token$")
_SUMS = re.compile(r"(?i)\b(?:sha\d*|md5|checksum|integrity|commit|digest|uuid|etag|revision|fingerprint)\b\s*[\"']?\s*[:= -]")


def _real(value: str, name: str = "", loose: bool = False) -> bool:
    """Whether a value is a literal secret and not a placeholder, an empty value or a look-up."""
    v = value.strip()
    if len(v) < 4 or _EMPTY.match(v) or _LOOKUP.search(v):
        return False
    low = re.sub(r"[^a-z]", "", v.lower())
    if low and low == re.sub(r"[^a-z]", "", name.lower()):
        return False
    if _SECRET_WORD.match(v) or v.lower() in ("password", "username", "user", "admin_password"):
        return False
    if re.fullmatch(r"[A-Z][A-Z_]*", v) and "_" in v:
        return False
    if not loose and re.fullmatch(r"[\d.,:/ -]+", v) and not re.fullmatch(r"\d{6,}", v):
        return False
    return True


def _bare_real(value: str, rest: str, name: str) -> bool:
    """An unquoted value: code would put a variable or a call there, so it must look like a literal."""
    if rest[:1] in "([" and rest[:1]:
        return False
    v = value.rstrip(".")
    if not _real(v, name) or re.match(r"^(?:self|this|os|sys|process|config|settings|args|opts|env)\b\.", v) or "->" in v or "::" in v:
        return False
    if re.match(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?[a-zA-Z]{0,2}$", v) and len(v) < 9:
        return False
    plain = bool(_IDENT.match(v))
    if not plain:
        return bool(re.search(r"[\d!@#$%^&*?+=~]", v)) or len(v) >= 16
    # a plain word: only where a whole line is a setting
    return bool(re.search(r"\d{4,}$", v))


def _login(v: str) -> bool:
    return _real(v, "password", loose=True) and v.lower() not in ("pass", "password", "passwd", "pwd", "secret")


def _settled(text: str, data: np.ndarray, p: int, anchor: str) -> tuple[int, int, int] | None:
    """(begin of the credential, start, end of the secret) of the format whose first characters end at a place, if the automaton accepts it."""
    if anchor in _STARTS:
        at = p + 1 - _STARTS[anchor]
        if at and re.match("[A-Za-z0-9_]", text[at - 1]):
            return None
    else:
        at = text.rfind(_FORMATS[anchor], 0, p + 1)
        if anchor.startswith("://"):
            scheme = _SCHEME.search(text, max(0, at - 60), at)
            at = scheme.start() if scheme else -1
        if at < 0:
            return None
    end, found = formats().longest(data, at)
    if end < 0:
        return None
    kind = min(found) - len(_TOKENS)
    if kind < 0:
        return None if re.search(r"x{8,}|X{8,}|0{10,}|EXAMPLE", text[at:end]) else (at, at, end)
    if kind == 0:
        longest = max((len(x) for x in re.findall(r"[A-Za-z0-9+/=]+", text[end:end + 400].replace("\\n", "\n").replace("\\r", ""))), default=0)
        return (at, end, _key_end(text, end)) if longest >= 24 else None
    if kind == 1:
        user = text.index("://", at) + 3
        start = text.index(":", user) + 1
        v = text[start:end - 1]
        return (start, start, end - 1) if _login(v) and not (re.match(r"^\d{2,5}$", v) and start == user + 1) else None
    start = text.index("=", at) + 1
    start += len(text[start:end]) - len(text[start:end].lstrip())
    return (start, start, end) if _real(text[start:end], text[at + 1:start - 1].strip(" \t=")) else None


def spans_in(text: str) -> list[tuple[int, int, int]]:
    """(begin of the credential, start, end of the secret) in a piece of a line, relative to the piece."""
    out = []
    for kind, pattern in _GRAMMAR.items():
        for m in pattern.finditer(text):
            d = m.groupdict()
            v, name = d.get("v") or d.get("v2") or "", d.get("name") or ""
            start, end = m.span("v2") if d.get("v2") else m.span("v")
            first = m.start()
            if kind in _BACKWARDS:
                first -= len(_BEGIN.search(text, max(0, first - 60), first).group())  # type: ignore[union-attr]
                name = text[first:m.end("name")]
            if name and kind not in ("signed",) and _ID_NAME.search(name):
                continue
            if kind in ("named", "spaced", "called", "attribute", "pair", "by"):
                joined, to = v, end + 1
                while (more := _MORE.match(text, to)) and more.start("v") - to < 8 and kind in ("named", "called"):
                    if "," in text[to:more.start("v")] and "paste" not in text[m.start():start] and "join" not in text[m.start():start]:
                        break
                    joined += more.group("v")
                    end, to = more.end("v"), more.end()
                if not _real(joined, name):
                    continue
                if kind in ("spaced", "pair") and not re.search(r"\d|[^\w\s]", joined) and len(joined.split()) < 3:
                    continue
                if kind == "named" and joined.startswith("-----BEGIN") or re.match(r"(?i)(?:ssh-(?:rsa|ed25519|dss)|-----BEGIN (?:PUBLIC|CERT))", joined):
                    continue
                if re.match(r"(?i)(?:bearer|basic)\s+\S*$", joined) and not _real(joined.split()[-1]):
                    continue
                if re.match(r"^[\w.+-]+://[^:@]*$", joined) and kind != "named":
                    continue
            elif kind in ("client", "sudo", "login", "slash"):
                if not _real(v, "password") or kind == "login" and not re.search(r"\d|[^\w\s]", v) and len(v.split()) < 3 or re.match(r"^[\w.+-]+://", v) or re.fullmatch(r"[\w-]+(?:\.[\w-]+)+", v) and kind == "login":
                    continue
            elif kind in ("reversed", "netrc"):
                if not _real(v, name):
                    continue
            elif kind == "bare":
                rest, head = d["rest"], text[:first]
                # a passphrase of several words fills the line
                line_setting = not re.search(r"[\w)\"']\s*$", re.sub(r"^\s*(?:[#;*]+|//+|--+|-|export|set)?\s*", "", head)) and not re.search(r"[(\[{]\s*$", head)
                words = (v + rest).strip()
                if line_setting and re.fullmatch(r"[a-z]+(?: [a-z]+){2,7}", words) and re.search(r"(?i)(?:pass|pwd|pw|kennwort|contrase|senha|secret|credential)", name):
                    end = m.start("v") + len(words)
                elif line_setting and _real(v, name) and not rest.strip(" ;,\r") and re.search(r"\d", v) and not re.search(r"[()]", v) and not re.fullmatch(r"-?[\d.]+", v) and not re.match(r"(?i)(?:self|this|os|args|config|process|env)\.", v) and ("#" in head or "//" in head or "--" in head or "*" in head or ";" in head or not head.strip() or head.strip() in ("-", "export")) and len(v) >= 6 and (not _IDENT.match(v) or re.search(r"\d{2,}$", v) and "_" not in v):
                    pass
                elif line_setting and _real(v, name) and not rest.strip(" ;,\r") and (re.fullmatch(r"[a-z]{16,}", v) or len(v) >= 8 and re.fullmatch(r"(?=.*[A-Z]{2})(?=.*[a-z]{2})[A-Za-z]+", v)):
                    pass
                elif not _bare_real(v, rest, name):
                    continue
            elif kind == "word":
                if not any(re.fullmatch(t, v) for t in _TOKENS) and not (re.match(r"^\s*(?:[#;*]+|//+|--+)\s*$", text[:first]) and not text[m.end():].strip() and _real(v, name) and re.search(r"\d", v) and len(v) >= 8 and (not _IDENT.match(v) or re.search(r"\d{4,}$", v))):
                    continue
            elif kind == "option":
                if not _real(v, name) or d.get("v2") and not (re.search(r"\d", v) and len(v) >= 6 or any(re.fullmatch(t, v) for t in _TOKENS)):
                    continue
            elif kind == "tagged":
                if not _real(v, name) or re.fullmatch(r"\s*[a-z]+\s*", v) and not re.search(r"\d", v):
                    continue
            elif kind in ("bearer", "header"):
                if not _real(v, name) or not re.search(r"\d", v) and (len(v) < 24 or v.islower()) or _IDENT.match(v) and len(v) < 20:
                    continue
                if kind == "header" and v.lower().startswith(("bearer", "basic")):
                    continue
            elif kind == "curl":
                if not _login(v):
                    continue
            elif kind == "signed":
                if not _real(v, "") or not re.search(r"\d", v) and v.islower():
                    continue
            out.append((start, start, end))
    return out


def find_in(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """For each text the (begin, start, end) of its secrets: absolute, sorted, without overlap."""
    joined = "\n".join(texts)
    data = np.frombuffer(joined.encode("ascii", "replace") if joined.isascii() else _bytes(joined), np.uint8)
    scan = automaton()
    ends, states = scan.hits_in(data)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.empty(0, np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(ends):
        return out
    doc = np.searchsorted(starts, ends, side="right") - 1
    for n in np.unique(doc).tolist():
        text, base = texts[n], int(starts[n])
        found: set[tuple[int, int, int]] = set()
        seen_to = -1
        end, line = -1, None
        own = data[base:base + len(text)]
        before = -1
        for p, state in zip((ends[doc == n] - base).tolist(), states[doc == n].tolist()):
            for anchor in scan.hits[state]:
                if _ANCHORS[anchor] in _STARTS or _ANCHORS[anchor] in _FORMATS:
                    if (span := _settled(text, own, p, _ANCHORS[anchor])) is not None and span[2] > span[1]:
                        found.add(span)
            if p == before:
                continue
            before = p
            if p > end:
                begin = text.rfind("\n", 0, p) + 1
                end = text.find("\n", p)
                end = len(text) if end < 0 else end
                seen_to = -1
            lo, hi = begin, end
            if hi - lo > LINE:
                if p + AFTER // 4 <= seen_to:
                    continue
                if line is None or line.begin != begin:
                    line = _LongLine(text, begin, end)
                lo, hi = line.piece(p)
                # never beyond the line: the next one has not been looked at
                seen_to = min(p + AFTER // 2, end)
            else:
                if p <= seen_to:
                    continue
                seen_to = end
            for b, s, e in spans_in(text[lo:hi]):
                if e > s:
                    found.add((b + lo, s + lo, e + lo))
        merged: list[tuple[int, int, int]] = []
        for b, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
            if merged and s < merged[-1][2]:
                merged[-1] = (merged[-1][0], merged[-1][1], max(e, merged[-1][2]))
            else:
                merged.append((b, s, e))
        out[n] = merged
    return out


def _bytes(text: str) -> bytes:
    """One byte per character; all that is not ASCII becomes 200, or a blank if it is one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points, np.where(np.isin(points, _BLANKS), 32, 200)).astype(np.uint8).tobytes()


_BLANKS = np.array([c for c in range(128, 0x3001) if chr(c).isspace()], np.uint32)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with a placeholder for each secret; line ends inside a key block stay, so line numbers do not move."""
    parts, at = [], 0
    for _, s, e in spans:
        parts += [text[at:s], "\n".join([PLACEHOLDER] + [""] * text.count("\n", s, e))]
        at = e
    return "".join(parts) + text[at:]


def _groups(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[tuple[list, list[str]]]:
    ids, texts, n = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        ids.append(i)
        texts.append(t)
        n += len(t)
        if n >= most:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in _groups(batch):
            rows = [(i, t.count("\n", 0, b) + 1) for i, t, spans in zip(ids, texts, find_in(texts)) for b, _, _ in spans]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["doc_id", "line_no"])


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in _groups(batch):
            rows = [(i, len(spans), redact(t, spans)) for i, t, spans in zip(ids, texts, find_in(texts)) if spans]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())],
                ["doc_id", "n_secrets", "redacted"],
            )


def find_secrets(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no) of each line in which a credential begins; lines counted from 1 and ended by a line feed.

    Null and empty texts and null ids give no rows; a repeated id gives the lines of all its texts, each once.
    Long texts are scanned whole, in overlapping chunks; lines over 1,500 characters are judged in pieces
    around each place, which are extended by the literals and tokens that they would cut.
    Other columns are ignored.  Map only but for the final distinct over the few found lines.
    """
    rows = texts_of(docs, doc, text).filter("doc_id is not null and text is not null and text <> ''")
    return rows.mapInArrow(_lines, "doc_id long, line_no long").distinct()


def redact_secrets(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_secrets, redacted): the affected documents with each secret value replaced by a placeholder, all else unchanged."""
    rows = texts_of(docs, doc, text).filter("doc_id is not null and text is not null and text <> ''")
    return rows.mapInArrow(_redacted, "doc_id long, n_secrets long, redacted string")
