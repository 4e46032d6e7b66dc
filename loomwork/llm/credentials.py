"""Credentials embedded in source code, settings and commands.

Method: the text is tokenized lexically (quoted literals with their escapes, words, operators) in one pass that carries the
state of its place - line and comment, current command, current statement, login fields, enclosing brackets, parameters of the
functions defined so far. Literals that are assigned or passed to credential-named identifiers are flagged unless they are
placeholders or references, and only the literal's contents are redacted, so delimiters, escapes and everything around stay as
they are. Literals whose own form is a credential (key blocks, user information in URLs, well-known token forms) are flagged
without a name. No rule looks at a fixed distance, and the time is in proportion to the text's length, however long its lines are.

Defined results: null or empty text has no credentials; a repeated credential is reported at every place; texts of
any length are read whole; JSON that can't be read has none, save plain-text tool results, which are read as text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.spans import Spans
from loomwork.sources.rawjson import Located, message_parts, opened, opened_located, parse_located, result_value, strings

#: Words of an identifier that make what it is given a credential; fixed values.
CREDENTIAL_WORDS = frozenset(
    "password passwd passwort passphrase passcode pass pwd pw secret token apikey authtoken credential credentials "
    "contraseña kennwort auth authorization pgpassword dbpassword mot_de_passe hasło пароль wachtwoord senha".split()
)
#: Words before "key" that make it a credential; fixed values.
KEY_WORDS = frozenset(
    "api access secret private signing service auth encryption account client master session license ledger shared hmac webhook deploy admin app".split()
)
#: Words of a callee that signs in or signs with what it is passed; fixed values.
CALL_WORDS = frozenset("client connect connection session login signin authenticate authorize auth sign hmac credentials".split())
#: Words that make a literal a reference or a placeholder.
PLACEHOLDER = re.compile(
    r"""(?ix) ^\s*$ | ^[*x•.\#_?-]+$ | ^<[^>]*>$ | ^\$ | \$\{ | \$\( | \{\{ | ^%[\w(%] | ^\[.*\]$ | ^\{[\w.]*\}$
    | ^vault: | ^secret:// | ^(?:arn|ref|env|op|ssm|file|kms|sops|aws-sm|gcp-sm|keyring)[:/]
    | \bos\.environ | \bgetenv | process\.env | \b(?:your|my|the|some|insert|enter)[ _-].*(?:here|key|token|secret|pass)
    | ^(?:change[_ -]?(?:me|it)|redacted|masked|hidden|removed|dummy|placeholder|example|sample|todo|tbd|fixme|none|null|nil|undefined
        |true|false|yes|no|on|off|empty|string|secret|password|passwd|token|key|pass|pwd|auth|optional|required|default|test|xxx+)$
    | ^(?:example|dummy|fake|placeholder|redacted|changeme|your)[-_] | \*{4,} | (?:^|[^\w])x{5,} | \.\.\.$ | ^…|…$ | ENC\[|!vault """
)
#: Forms that are credentials by themselves.
FORMS = re.compile(
    r"""(?x) (?<![\w-])eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{6,} | \b[a-z]{2,5}_(?:live|prod|secret)_[A-Za-z0-9]{16,}
    | \bgh[pousr]_[A-Za-z0-9]{30,} | \bAKIA[A-Z0-9]{16}\b | \bxox[abprs]-[\w-]{10,} | \bglpat-[\w-]{16,} | (?<![\w-])sk-[\w-]{20,} """
)
KEY_BEGIN = re.compile(r"-----BEGIN (?!PUBLIC|CERTIFICATE|[A-Z0-9 ]*PUBLIC)[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
KEY_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
PUBLIC_BLOCK = re.compile(
    r"-----BEGIN (?:[A-Z0-9 ]*PUBLIC KEY|CERTIFICATE(?: REQUEST)?)-----.*?(?:-----END [A-Z0-9 ]*-----|\Z)"
    r"|\bssh-(?:rsa|ed25519|dss) [A-Za-z0-9+/=]+|\bsha(?:1|256|384|512)[-:][A-Za-z0-9+/=]+",
    re.S,
)
URL_LOGIN = re.compile(r"(?<![\w+.-])[a-zA-Z][\w+.-]*://([^\s:/@'\"`<>]*):([^\s/'\"`<>]+?)@(?=[\w.\[-])")
SCHEME = re.compile(r"(?i)^(?:bearer|token|basic|apikey|digest|key|bot)\s+(?=\S)")
_BARE_SCHEME = re.compile(r"(?i)(?:bearer|token|basic|apikey)[ \t]+")

#: Only strings with one of these can hold a credential.
TRIGGER = re.compile(
    r"(?i)pass|pwd|\bpw\b|secret|token|key|auth|credential|kennwort|contrase|hasło|парол|wachtwoord|senha|://[^\s/]*:|-----BEGIN|eyJ|_live_|_prod_"
    r"|AKIA|gh[pousr]_|glpat|xox|sk-|login|\bcurl\b|\s-u\b|mysql|mariadb|mongo|sshpass|client|connect|session|hmac|sign"
)
#: The lexical classes: quoted literals keep their escapes, words keep inner dots and dashes.
TOKENS = re.compile(
    r"""(?xs) (?P<str>"(?:[^"\\\n]|\\.)*+" | '(?:[^'\\\n]|\\.)*+' | `(?:[^`\\]|\\.)*+`)
    | (?P<esc>\\["']) | (?P<flag>(?<![\w-])--?[A-Za-z][\w-]*) | (?P<word>[^\W\d][\w.-]*|_[\w.-]*)
    | (?P<op>:=|=>|->|==|!=|[=:<>(),;{}\[\]|&?$]) | (?P<gap>[ \t]+) | (?P<line>\n) | (?P<num>\d[\w.]*) | (?P<rest>.) """
)
_SPLIT = re.compile(r"[\W_]+|(?<=[a-zа-яé0-9])(?=[A-ZА-Я])|(?<=[A-Z])(?=[A-Z][a-z])")
#: An unquoted value: up to white space or a delimiter that ends a setting.
BARE = re.compile(r"""[^\s"'`;,<>()\[\]{}&|\\]+""")
#: Where a comment of a line begins; what in one names a credential.
_COMMENT = re.compile(r"(?:^|(?<=\W))(?:#|//|--|/\*|<!--)(?=\s)", re.M)
_COMMENT_NAME = re.compile(r"(?i)\b(?:pass(?:word|phrase)?|secret|token|credential|login word|api key|passwort|kennwort)\b")
#: What may stand before a name at the start of a line: marks of lists and of diffs, and the first part of the name.
_LINE_LEAD = re.compile(r"[-+ \t]*[\w.-]*")
#: The mark of a folded or literal block, and the indent of its first line; a line of it.
_FOLDED = re.compile(r"[|>][-+0-9]{0,2}[ \t]*\n(?:[ \t]*\n)*( +)(?=\S)")
_BLOCK_LINE = re.compile(r"[ \t]*(\S(?:[^\n]*\S)?)[ \t]*(?:\n|\Z)")
#: Commands whose -p is a password; fixed values.
_PASSWORD_COMMANDS = frozenset(("mysql", "mysqldump", "mariadb", "sshpass", "mongo", "docker login"))
_GLUED = ("mysql", "mysqldump", "mariadb")
_LOGIN_FIELDS = frozenset(("machine", "login", "user", "username"))
_DEFINES = frozenset(("def", "function", "func", "fn", "fun", "sub"))
_PASSWORD_NAME = re.compile(r"(?i)pass|pwd|^pw$|wort|-u|-p")
_USER = re.compile(r"[\w.@-]+:(?=.)")
_names: dict[str, bool] = {}


def is_credential_name(name: str) -> bool:
    """Whether the last words of an identifier name a credential: API_KEY, authToken, x-api-key, db.password; not token_ttl."""
    known = _names.get(name)
    if known is None:
        words = [w.lower() for w in _SPLIT.split(name) if w]
        while words and words[-1].isdigit():
            words.pop()
        last = words[-1] if words else ""
        known = last in CREDENTIAL_WORDS or (last == "key" and len(words) > 1 and words[-2] in KEY_WORDS) or (
            last not in ("monkey", "turkey") and bool(re.search(r"(?:password|passwd|apikey|secret|authtoken|accesstoken)$", last))
        )
        if len(_names) < 100_000:
            _names[name] = known
    return known


def entropy(text: str) -> float:
    """Bits per character."""
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in (text.count(c) for c in set(text))) if n else 0.0


def looks_random(text: str) -> bool:
    """Mixed character classes and many different characters, or long hexadecimal or upper-case codes, as in generated tokens."""
    classes = sum(bool(re.search(p, text)) for p in ("[a-z]", "[A-Z]", r"\d", r"[+/=_.-]"))
    return len(text) >= 16 and not re.search(r"\s", text) and (
        classes >= 3 and entropy(text) >= 3.4 or bool(re.fullmatch(r"[0-9a-fA-F]{32,}|(?=.*\d)(?=.*[A-Z])[A-Z0-9]{16,}", text))
    )


_CODE = re.compile(r"[(){}\[\]]|=>|->|^\w+(?:\.[a-z_]\w*)+$|^[A-Z][A-Z0-9]*_[A-Z0-9_]+$")
_PATHLIKE = re.compile(r"^(?:\.{0,2}/|~/|[A-Za-z]:\\|https?://|[\w.-]+(?:/[\w.-]+)+\.[a-z]{1,5}$)")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_NUMBER = re.compile(r"[\d.]+(?:ms|s|m|h|d|kb|mb|gb)?")
_DOTTED = re.compile(r"[A-Za-z_]+(?:\.[A-Za-z_]+)+")


def is_literal_secret(value: str, quoted: bool, strict: bool = False, certain: bool = False) -> bool:
    """Whether a value given to a credential name is one, rather than a reference, placeholder, number or path; of any length.

    strict: the value stands bare in running text, so it must hold a digit or a mixture of classes. certain: nothing but a literal can stand there."""
    if not value or PLACEHOLDER.search(value) or _PATHLIKE.search(value) and not (looks_random(value) and entropy(value) >= 4):
        return False
    if not (quoted or certain) and len(value) == 1:
        return False  # a variable or a mark, not a literal
    if _NUMBER.fullmatch(value) and not (value.isdigit() and (quoted or looks_random(value))):
        return False
    if not quoted and not certain and (_CODE.search(value) and not looks_random(value) or _DOTTED.fullmatch(value)):
        return False
    if quoted and re.search(r"\s", value):
        return False
    if strict and not (re.search(r"\d", value) or looks_random(value) or re.search(r"[a-z][A-Z]|[!@#%^*+]", value)):
        return False
    return True


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every credential in text, in order and without overlap.

    start and end bound the literal's contents: no quotes, names, users, schemes or prefix words."""
    if not text or not TRIGGER.search(text):
        return []
    found: list[tuple[int, int, str]] = []
    barred: list[tuple[int, int]] = []
    if "-----BEGIN" in text or "ssh-" in text or "sha" in text:
        if "PRIVATE KEY" in text:
            found += [(a, b, "private_key") for a, b in _key_blocks(text)]
        barred = [m.span() for m in PUBLIC_BLOCK.finditer(text)]
    taken = Spans()
    for a, b in sorted([(a, b) for a, b, _ in found] + barred):
        taken.add(a, b)

    def add(a: int, b: int, kind: str) -> None:
        if a < b and taken.add(a, b):
            found.append((a, b, kind))

    if "://" in text:
        for m in URL_LOGIN.finditer(text):
            if not PLACEHOLDER.search(m[2]):
                add(m.start(2), m.end(2), "password")
            else:
                taken.add(*m.span(2))
    _Lexer(text, add).run()
    for m in FORMS.finditer(text):
        if not PLACEHOLDER.search(m[0]):
            add(m.start(), m.end(), "token")
    return sorted(found)


def _key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """From each BEGIN of a private key to the END after it."""
    begin = KEY_BEGIN.search(text)
    while begin and (end := KEY_END.search(text, begin.end())):
        yield begin.start(), end.end()
        begin = KEY_BEGIN.search(text, end.end())


class _Lexer:
    """One pass over the tokens of a text. What a rule needs to know of the place - the line's comment, whether a statement or
    command is open, which field of a login line this is - is state that the pass carries, not a look back over characters."""

    def __init__(self, text: str, add: Callable[[int, int, str], None]):
        self.text, self.add = text, add
        self.toks = [(m.lastgroup, m.start(), m.end()) for m in TOKENS.finditer(text)]
        self.n = len(self.toks)
        self.depths: list[int] = []
        self.calls: dict[int, tuple[int, list[int]]] | None = None
        #: By function name, the places of its credential-named parameters.
        self.parameters: dict[str, set[int]] = {}
        self.said: dict[int, int] = {}  # by line end, where its comment begins if that names a credential, else -1
        self.line_ends: list[int] | None = None
        self.examined = 0  # end of the last bare value: names inside it are part of it
        self._enter_line(0)

    def _enter_line(self, start: int) -> None:
        self.line_start, self.statements, self.command = start, 0, ""
        self._lead = self._comment = None

    # --- tokens -----------------------------------------------------------------------------

    def word(self, i: int) -> str:
        return self.text[self.toks[i][1] : self.toks[i][2]] if i < self.n else ""

    def skip(self, i: int, lines: bool = False) -> int:
        """The first token from i on that is no gap (and, with lines, no line end)."""
        while i < self.n and (self.toks[i][0] in ("gap", "esc") or lines and self.toks[i][0] == "line"):
            i += 1
        return i

    def back(self, i: int) -> int:
        """The last token before i that is no gap or line end; -1 without one."""
        i -= 1
        while i >= 0 and self.toks[i][0] in ("gap", "esc", "line"):
            i -= 1
        return i

    def depth(self, i: int) -> int:
        """Open brackets before token i; computed once for all."""
        if not self.depths:
            level = 0
            for kind, a, _ in self.toks:
                self.depths.append(level)
                if kind == "op":
                    level = level + 1 if self.text[a] in "([{" else max(0, level - 1) if self.text[a] in ")]}" else level
        return self.depths[i]

    def in_comment(self, a: int) -> bool:
        """Whether a comment of the current line began before a."""
        if self._comment is None:
            m = _COMMENT.search(self.text, self.line_start, self._line_end(self.line_start))
            self._comment = m.start() if m else len(self.text) + 1
        return self._comment < a

    def leads_line(self, a: int) -> bool:
        """Whether only marks and word characters stand before a on the current line."""
        if self._lead is None:
            self._lead = _LINE_LEAD.match(self.text, self.line_start).end()
        return self._lead >= a

    def _line_end(self, at: int) -> int:
        if self.line_ends is None:
            self.line_ends = [m.start() for m in re.finditer("\n", self.text)]
        k = bisect_left(self.line_ends, at)
        return self.line_ends[k] if k < len(self.line_ends) else len(self.text)

    def _start_of_line(self, end: int) -> int:
        """The start of the line that ends at end."""
        k = bisect_left(self.line_ends, end)
        return self.line_ends[k - 1] + 1 if k else 0

    # --- values -----------------------------------------------------------------------------

    def flag(self, a: int, b: int, name: str) -> None:
        self.add(a, b, "password" if _PASSWORD_NAME.search(name) else "token")

    def folded(self, m: re.Match, name: str) -> None:
        """The lines of a folded or literal block (YAML), if each is one word: together a value, flagged line by line."""
        lead = len(m[1])
        if lead <= len(re.compile(" *").match(self.text, self.line_start)[0]):
            return
        words, pos = [], m.start(1)
        while self.text.startswith(m[1], pos) and (line := _BLOCK_LINE.match(self.text, pos)):
            words.append(line)
            pos = line.end()
        if words and all(BARE.fullmatch(w[1]) for w in words) and is_literal_secret("".join(w[1] for w in words), False, False, True):
            for w in words:
                self.flag(*w.span(1), name)

    def value(self, i: int, name: str, bare: bool, strict: bool, certain: bool = False) -> None:
        """The literal that starts at token i, or on a later line inside open brackets or behind a mark of folded text."""
        text, i = self.text, self.skip(i)
        if i >= self.n:
            return
        if i > 1 and self.toks[i - 1][0] == "gap" and self.word(i - 2) == ":" and (m := _FOLDED.match(text, self.toks[i][1])):
            self.folded(m, name)
            return
        after = self.skip(i + 1)
        wrapped = self.word(i) == "(" and after < self.n and self.toks[after][0] == "line"
        if wrapped or self.toks[i][0] == "line" and self.depth(i):
            i = self.skip(after if wrapped else i, lines=True)
            if i >= self.n or self.toks[i][0] != "str" or wrapped and self.word(self.skip(i + 1, lines=True)) != ")":
                return
        kind, a, b = self.toks[i]
        quoted = kind == "str"
        if quoted:
            lo, hi = a + 1, b - 1
        elif not bare or kind == "line" or not (m := BARE.match(text, a)):
            return
        else:
            lo, hi = m.span()
            self.examined = max(self.examined, hi)
            if text[hi : hi + 1] in ("(", "[", "{"):
                return
        scheme = SCHEME.match(text[lo:hi])
        if scheme:
            lo += scheme.end()
        elif not quoted and (m := _BARE_SCHEME.match(text, lo)) and (follow := BARE.match(text, m.end())):
            lo, hi = follow.span()
        user = _USER.match(text, lo, hi) if name in ("-u", "--user") else None
        if name in ("-u", "--user"):
            if not user:
                return
            lo = user.end()
        listed = text[hi : hi + 1] == ";" and self.statements > 0
        if is_literal_secret(text[lo:hi], quoted or bool(user), strict, certain or listed):
            self.flag(lo, hi, name)

    # --- the pass ---------------------------------------------------------------------------

    def run(self) -> None:
        field, login = 0, -(1 << 40)  # running number of blank-separated fields, and that of the last login keyword
        gap = True
        for i, (kind, a, b) in enumerate(self.toks):
            if kind == "gap" or kind == "line":
                gap = True
                if kind == "line":
                    held = self.command if self.text[a - 1 : a] == "\\" else ""
                    self._enter_line(b)
                    self.command = held  # a command goes on behind a backslash
                continue
            if gap:
                field, gap = field + 1, False
            if kind == "op":
                if self.text[a] in ";|&":
                    self.statements += self.text[a] == ";"
                    self.command = ""
            elif kind == "word":
                self._word(i, a, b, field - login)
                if self.word(i).lower() in _LOGIN_FIELDS:
                    login = field
                self._name_command(self.word(i))
            elif kind == "flag":
                if a == self.line_start:
                    self._name_command(self.word(i)[1:])  # the mark of a removed line
                self._flag(i, a)
            elif kind == "str":
                self._quoted(i, a, b)

    def _name_command(self, name: str) -> None:
        first = re.split("[.-]", name.lower(), maxsplit=1)[0]
        if first in _PASSWORD_COMMANDS or first == "docker":
            self.command = first
        elif self.command == "docker" and first == "login":
            self.command = "docker login"

    def _word(self, i: int, a: int, b: int, fields: int) -> None:
        """fields: how many blank-separated fields lie between here and the last login keyword, both counted."""
        name = self.word(i).rstrip(".-")
        if name in _DEFINES:
            self._definition(i)
        if a < self.examined:
            return
        commented = lambda: self.in_comment(a)
        if not is_credential_name(name) and not (name == "key" and commented()):
            if self.word(i + 1) == "(":
                self._passed(i, name)
            return
        j = self.skip(i + 1)
        if j >= self.n:
            return
        op, beside = self.word(j), j == i + 2 and self.toks[j][0] in ("word", "num", "rest")
        if op in ("=", ":=", "=>", ":"):
            k = self.skip(j + 1)
            running = op == ":" and self.text.startswith(": ", b) and not self.leads_line(a)
            self.value(k, name, k < self.n and self.toks[k][0] != "line", running)
        elif op == ">" and self.text[a - 1 : a] == "<":
            end = self.text.find("<", b)
            if end > 0 and self.text[end + 1 : end + 2] == "/" and is_literal_secret(self.text[b + 1 : end].strip(), True):
                self.add(b + 1, end, "password")
        elif self.toks[j][0] == "str" and j == i + 2:
            self.value(j, name, False, False)
        elif beside and commented():
            self.value(j, name, True, name != "pw", name == "pw")
        elif beside and fields in (2, 4):  # login bob password ..., machine h login bob password ...
            self.value(j, name, True, False, True)
        elif op == "(" and j == i + 1:
            self._passed(i, name)

    def _flag(self, i: int, a: int) -> None:
        name, j = self.word(i).removeprefix("-D"), i + 1
        k = self.skip(j)
        if self.word(k) in ("=", ":=", ":") and is_credential_name(name):
            self.value(k + 1, name, True, False)
        elif is_credential_name(name) or name.lower() in ("--key", "--token", "--secret", "--pass"):
            if self.word(j) in ("=", ":") or j < self.n and self.toks[j][0] == "gap":
                self.value(j + 1, name, True, False)
        elif name in ("-u", "--user"):
            self.value(j + 1 if self.word(j) == "=" else j, name, True, False)
        elif name == "-p" and self.command in _PASSWORD_COMMANDS:
            self.value(j, name, self.command == "sshpass", False)
        elif name.startswith("-p") and len(name) > 2 and not name.startswith("--") and self.command in _GLUED:
            m = BARE.match(self.text, a + 2)
            if m and is_literal_secret(m[0], False, True):
                self.add(m.start(), m.end(), "password")

    def _quoted(self, i: int, a: int, b: int) -> None:
        inner = self.text[a + 1 : b - 1]
        if inner and not re.search(r"\s", inner) and is_credential_name(inner):
            j = self.skip(i + 1)
            op = self.word(j)
            if op in (":", "=", "=>") or op == "," and self._first_argument(i):
                self.value(j + 1, inner, op in (":", "="), False)
            elif op == ">":
                lo = self.toks[j][2]
                hi = self.text.find("<", lo)
                if hi > 0 and self.text[hi + 1 : hi + 2] == "/" and is_literal_secret(self.text[lo:hi].strip(), True):
                    self.add(lo, hi, "password" if re.search("(?i)pass|pwd", inner) else "token")
            elif op == "]":
                k = self.skip(j + 1)
                if self.word(k) == "=":
                    self.value(k + 1, inner, False, False)
        elif re.search(r"(?i)pass|token|secret|key|auth|pwd|://", inner):
            self._settings(a + 1, b - 1)

    def _first_argument(self, i: int) -> bool:
        """Whether token i opens the arguments of a call."""
        k = self.back(i)
        return k > 0 and self.word(k) == "(" and self.toks[self.back(k)][0] in ("word", "num") and self.back(k) >= 0

    def _settings(self, lo: int, hi: int) -> None:
        """Settings inside a quoted literal: headers, connection strings, query parameters."""
        for m in _INNER.finditer(self.text, lo, hi):
            if not is_credential_name(m[1]):
                continue
            given, assigned = m[3], m[2].strip() == "="
            scheme = None if assigned else SCHEME.match(given)
            start = m.start(3) + (scheme.end() if scheme else 0)
            got = self.text[start : m.end(3)].split(" ")[0]
            if is_literal_secret(got, False, not assigned):
                self.add(start, start + len(got), "password" if re.search("(?i)pass|pwd", m[1]) else "token")

    # --- calls ------------------------------------------------------------------------------

    def _definition(self, i: int) -> None:
        """Remember which parameters of a function that is defined here are credential-named."""
        k = self.skip(i + 1)
        if k >= self.n or self.toks[k][0] != "word" or self.word(k + 1) != "(":
            return
        close, _ = self._call(k + 1)
        place, fresh, found = 0, True, set()
        for j in range(k + 2, min(close, self.n)):
            kind = self.toks[j][0]
            if self.word(j) == "," and self.depth(j) == self.depth(k + 2):
                place, fresh = place + 1, True
            elif kind == "word" and fresh:
                fresh = False
                if is_credential_name(self.word(j)):
                    found.add(place)
        if found:
            self.parameters[self.word(k)] = found

    def _call(self, opening: int) -> tuple[int, list[int]]:
        if self.calls is None:
            self.calls = _calls(self.text, self.toks)
        return self.calls.get(opening, (self.n, []))

    def _passed(self, i: int, name: str) -> None:
        """Literals passed by position: to a credential-named parameter of a function of this text, to a callee whose own name is a
        credential's, random ones to a callee that signs in, or the last one where a comment on the call names a credential."""
        words = {w.lower() for w in _SPLIT.split(name) if w}
        known, signs, named = self.parameters.get(name.rsplit(".", 1)[-1]), bool(words & CALL_WORDS), is_credential_name(name)
        if not (known or signs or named):
            return
        close, args = self._call(i + 1)
        before = self.back(i)
        if not args or before >= 0 and self.word(before) in _DEFINES:
            return
        end, last = self.toks[min(close, self.n - 1)][2], self.toks[args[-1]][2]
        commented = signs and len(args) > 1 and (self._named_after(end) or self._line_end(last) < end and self._named_after(last))
        places = self._places(i + 1, close) if known else {}
        for k, arg in enumerate(args):
            a, b = self.toks[arg][1] + 1, self.toks[arg][2] - 1
            got = self.text[a:b]
            if self.word(self.back(arg)) in ("=", ":", "=>"):
                continue  # by name, which is judged where it stands
            if known and places.get(arg) in known and is_literal_secret(got, True):
                self.add(a, b, "token")
            elif commented and k == len(args) - 1 and is_literal_secret(got, True):
                self.add(a, b, "password")
            elif signs and k and looks_random(got) and is_literal_secret(got, True) and not _UUID.fullmatch(got):
                self.add(a, b, "password" if commented else "token")
            elif named and len(args) == 1 and looks_random(got) and is_literal_secret(got, True) and not _UUID.fullmatch(got):
                self.add(a, b, "token")

    def _places(self, opening: int, close: int) -> dict[int, int]:
        """The place among the arguments of each token directly inside a call."""
        found, place, level = {}, 0, self.depth(opening) + 1
        for j in range(opening + 1, min(close, self.n)):
            if self.depth(j) == level:
                if self.word(j) == ",":
                    place += 1
                else:
                    found[j] = place
        return found

    def _named_after(self, end: int) -> bool:
        """Whether a comment that begins behind end on its line names a credential; each line's comment is read once."""
        stop = self._line_end(end)
        if stop not in self.said:
            m = _COMMENT.search(self.text, self._start_of_line(stop), stop)
            self.said[stop] = m.start() if m and _COMMENT_NAME.search(self.text, m.start(), stop) else -1
        return self.said[stop] >= end


_INNER = re.compile(
    r"""(?<![\w.-])([A-Za-z_][\w.-]*+)(\s*+[=:]\s*)((?:(?:[Bb]earer|[Tt]oken|[Bb]asic|[Aa]pi[Kk]ey)\s+)?[^\s"'`;&,\\]+)"""
)


def _calls(text: str, toks: list) -> dict[int, tuple[int, list[int]]]:
    """By the token of each opening bracket of a call: the token that closes it and the literals directly inside; one pass. An unclosed one ends with its line."""
    found: dict[int, tuple[int, list[int]]] = {}
    open_now: list[tuple[int, list[int]]] = []
    for j, (kind, a, _) in enumerate(toks):
        if kind == "str" and open_now:
            open_now[-1][1].append(j)
        elif kind == "op" and text[a] == "(":
            open_now.append((j, []))
        elif kind == "op" and text[a] == ")" and open_now:
            start, args = open_now.pop()
            found[start] = j, args
    lines = [j for j, t in enumerate(toks) if t[0] == "line"] if open_now else []
    for start, args in open_now:
        k = bisect_right(lines, start)
        stop = lines[k] if k < len(lines) else len(toks)
        found[start] = stop, args[: bisect_right(args, stop)]
    return found


MARKER = "REDACTED_{kind}"


def redact(text: str | None, marker: str = MARKER) -> str | None:
    """text with each credential's contents replaced; quotes, escapes and code around it stay. Null stays null."""
    return _replaced(text, [(a, b, marker.format(kind=kind.upper())) for a, b, kind in find_secrets(text)]) if text else text


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, pos = [], 0
    for a, b, new in sorted(spans):
        out += [text[pos:a], new]
        pos = b
    return "".join(out) + text[pos:]


def _located_spans(values: list[str], marker: str) -> list[tuple[int, int, str]]:
    """Of decoded strings that know their place: where their credentials stand in the raw text."""
    return [(x.raw(a), x.raw(b), marker.format(kind=kind.upper())) for x in values if isinstance(x, Located) for a, b, kind in find_secrets(x)]


def redact_message(message: str | None, marker: str = MARKER) -> str | None:
    """A raw message whose tool inputs have no credentials. Strings are judged as decoded, at any depth and also inside JSON that a
    string holds, and only the characters of the credentials change in the raw text. Null or unreadable text stays as it is."""
    if message is None or "tool_use" not in message or not any(
        find_secrets(x) for _, part in message_parts(message) if part.get("type") == "tool_use" for x in strings(opened(part.get("input")))
    ):
        return message
    value = opened_located(parse_located(message))
    inputs = [opened_located(p.get("input")) for p in value["content"] if isinstance(p, dict) and p.get("type") == "tool_use"]
    return _replaced(message, _located_spans([x for i in inputs for x in strings(i)], marker))


def redact_result(result: str | None, marker: str = MARKER) -> str | None:
    """A raw tool result without credentials; plain text is redacted as it is."""
    if result is None or not any(find_secrets(x) for x in strings(result_value(result))):
        return result
    value = parse_located(result)
    return redact(result, marker) if value is None else _replaced(result, _located_spans(strings(opened_located(value)), marker))


_FOUND = pa.schema([("place", pa.string()), ("row_id", pa.int64()), ("part_no", pa.int64()), ("found_text", pa.string()), ("kind", pa.string())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(_FOUND)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _FOUND.types)], schema=_FOUND)


def _log_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for entry, message, result in zip(*(c.to_pylist() for c in batch.columns)):
            if message is not None and "tool_use" in message:
                for no, part in message_parts(message):
                    if part.get("type") == "tool_use":
                        for text in strings(opened(part.get("input"))):
                            rows += [("input", entry, no, text[a:b], kind) for a, b, kind in find_secrets(text)]
            if result is not None:
                for text in strings(result_value(result)):
                    rows += [("result", entry, 0, text[a:b], kind) for a, b, kind in find_secrets(text)]
        yield _rows(list(dict.fromkeys(rows)))


def _summary_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for message, summaries in zip(*(c.to_pylist() for c in batch.columns)):
            for no, text in enumerate(summaries or []):
                rows += [("summary", message, no, text[a:b], kind) for a, b, kind in find_secrets(text)]
        yield _rows(list(dict.fromkeys(rows)))


_DDL = "place string, row_id long, part_no long, found_text string, kind string"


def credentials(log_entries: DataFrame, messages: DataFrame) -> DataFrame:
    """place, row_id, part_no, found_text, kind of every credential, distinct within its row; ids are the tables' own unique ids.

    Rows never leave their task, so there is no shuffle; rows without JSON, tools or summaries give none."""
    log = log_entries.select("entry_id", "message", "tool_use_result").where("message like '%tool_use%' or tool_use_result is not null")
    says = messages.select("message_id", F.transform("tools", lambda t: t["summary"]).alias("summaries")).where("exists(summaries, x -> x <> '')")
    return log.mapInArrow(_log_batches, _DDL).unionByName(says.mapInArrow(_summary_batches, _DDL))


def redacted(df: DataFrame, columns: list[str] | dict[str, Callable[[str | None], str | None]]) -> DataFrame:
    """df with the credentials of the named text columns replaced by typed markers; other columns stay as they are.

    columns: names of columns of plain text, or by name how a column is redacted: redact, or redact_message or redact_result for raw JSON."""
    ways = columns if isinstance(columns, dict) else dict.fromkeys(columns, redact)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            new = lambda c, how: pa.array([how(t) for t in c.to_pylist()], pa.string())
            cols = [new(c, ways[name]) if name in ways else c for name, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return df.mapInArrow(batches, df.schema)


def redacted_log(log_entries: DataFrame) -> DataFrame:
    """log_entries with redacted tool inputs (in message) and tool results; every row and column is there. No shuffle."""
    return redacted(log_entries, {"message": redact_message, "tool_use_result": redact_result})


def redacted_messages(messages: DataFrame) -> DataFrame:
    """messages with redacted summaries of tools; every row and column is there. No shuffle."""
    at, schema = messages.columns.index("tools"), messages.schema

    def shown(tools: list[dict] | None) -> list[dict] | None:
        return tools and [t and t | {"summary": redact(t["summary"])} for t in tools]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cols = list(batch.columns)
            cols[at] = pa.array([shown(t) for t in cols[at].to_pylist()], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return messages.mapInArrow(batches, schema)
