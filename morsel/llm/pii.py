"""Personal data and secrets by a skip-chain conditional random field (operator 10).

Nodes are the pieces of a text that could be part of an entity: whatever holds a digit or @, or at least CAPS capitals; numbers,
telephone numbers, account numbers and addresses written in groups, each as one piece; IPv6 addresses; and whatever stands behind
a word such as "password" and a sign of equality or a colon, wherever in the document it is repeated. All other words can only be "other" and separate the field.

- Each piece has features of itself, at its whole length (shape, digits, checksums), and of the words before and after it.
- Chain edges join neighbouring pieces with no word between them.
- Skip edges tie all mentions of the same letters and digits in a document, whatever their case and the marks between them, to
  one hub variable. As in skip-chain fields, the potential they share has the features of all of them, each once: what tells one
  mention tells all, at any distance, and a thousand bare mentions say no more than one. Edges grow linearly with mentions.

Weights are trained here, on texts that `examples` writes with known entities (N_TRAIN of them, fixed seed), by gradient of the
likelihood with marginals of loopy belief propagation. Inference runs rounds of messages over all documents of a batch at once,
until none changes by TOLERANCE. Only messages that may still change are sent again, and a document's result doesn't depend on
what else is in the batch. One narrow pass: no shuffle. From round STEADY on messages move by ever smaller steps, which settles
loops that would swing; what still swings ends at MOST rounds.

Cases: a null or empty text has no entities, and stays as it is when redacted; repeated rows each their own row; a null doc_id,
or one that is no number, is a null id; other columns are ignored by find() and pass through redact(); an empty table gives no
rows; of labels that are equally likely the first of LABELS is taken; very long texts and words are read whole. Offsets count
characters.
"""

from __future__ import annotations

import ipaddress
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morsel.llm.common import blocks, text_buffer, words

LABELS = ("OTHER", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "ID")
L = len(LABELS)
CAPS, N_TRAIN, EPOCHS, SEED = 16, 900, 70, 11
TOLERANCE, STEADY, MOST = 1e-6, 1000, 100_000
CHAIN, SKIP = 0, 1

_SIMPLE = re.compile(r"\+?\w(?:[\w.+/@\-]*\w)?")
#: What is one piece although spaces, brackets or colons cut it: IPv6 addresses, card, account and telephone numbers in groups.
_GROUPED = r"""(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]+(?:\.\d+){0,3}(?![\w:])
|(?<![\w.+\-])\d{4}(?:[ \-]\d{4}){2,3}(?:[ \-]\d{1,4})?(?![\w\-])
|(?<![\w.+\-])\d{4}[ \-]\d{6}[ \-]\d{5}(?![\w\-])
|(?<!\w)[A-Z]{2}\d{2}(?:[ ][A-Z0-9]{4}){2,7}(?:[ ][A-Z0-9]{1,4})?(?!\w)
|(?<!\w)\+\d{1,3}(?:[ .\-]?\(?\d{1,4}\)?){2,6}(?![\w@])
|(?<!\w)\(\d{2,5}\)[ ]?\d{2,4}[ .\-]\d{3,4}(?!\w)"""
_PIECE = re.compile(f"{_GROUPED}|(?P<simple>{_SIMPLE.pattern})", re.X)
_EMAIL = re.compile(r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+")
_IP = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})")
_IBAN = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}")
_PASS = r"pass(?:word|wd|phrase|code)?|pwd"
_NAMED = rf"{_PASS}|token|secret|api[_\-]?key|credentials?"
_KEYS = re.compile(rf"(?:^|[^a-z])(?:(?P<pass>{_PASS})|{_NAMED}|key|auth|bearer)[\"']?\s*(?P<sign>[=:]?)\s*(?P<quote>[\"'>(]*)$")
#: A name and a sign of equality or a colon; and what follows up to white space or a quote.
_SIGN = re.compile(rf"(?:{_NAMED})[\"']?[ \t]*[=:][ \t]*[\"']?".encode(), re.I)
_VALUE = re.compile(rb"[^\s\"'<>]+")
_SHAPE = re.compile(r"(0+)|(a+)|(A+)")
_WORD = re.compile(r"[^\W\d_]+|[=:#@$(\"]")
_NEXT = re.compile(r"[^\W\d_]+|[=:#@$%)\"]")
_DIGIT_AT = np.zeros(256, dtype=np.uint8)
_DIGIT_AT[[*range(48, 58), 64]] = 1
_UPPER = np.zeros(256, dtype=np.uint8)
_UPPER[65:91] = 1
_COLON = np.zeros(256, dtype=np.uint8)
_COLON[58] = 1
#: Bytes before and after a piece in which its neighbours are looked for; a word that begins in them counts whole.
WINDOW = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(t: str) -> bool:
    """Whether letters and digits have the checksum of an account number."""
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def is_ipv6(t: str) -> bool:
    try:
        return ":" in t and ipaddress.ip_address(t).version == 6
    except ValueError:
        return False


def shape(t: str) -> str:
    s = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in t)
    return _SHAPE.sub(lambda m: m.group()[0] + (str(min(len(m.group()), 5)) if m.group()[0] == "0" else ""), s)


def features(t: str, before: str, after: str) -> list[str]:
    """Of a piece, the text shortly before it and after it."""
    out = ["bias", f"s={shape(t)}"]
    digits = "".join(c for c in t if "0" <= c <= "9")
    n = len(digits)
    out.append(f"d={min(n, 20)}")
    left = before.lower()
    prev, nxt = _WORD.findall(left), _NEXT.match(after.strip().lower())
    key = _KEYS.search(left)
    if prev:
        out.append("p=" + prev[-1])
        if len(prev) > 1 and prev[-1] in "=:#(\"":
            out.append("q=" + next((x for x in reversed(prev) if x not in "=:#(\""), ""))
    if nxt:
        out.append("n=" + nxt.group())
    if before[-1:] == "(" and after[:1] == ")":
        out.append("paren")
    if "@" in t:
        out.append("email" if _EMAIL.fullmatch(t) else "at")
    if m := _IP.fullmatch(t):
        out.append("ip" if all(int(x) < 256 for x in m.groups()) else "ip>")
    if is_ipv6(t):
        out.append("ipv6")
    bare = re.sub(r"[ \-]", "", t)
    if 13 <= n <= 19 and bare.isdigit():
        out += ["c=" + str(luhn(digits)), f"c{n}={t[0]}"]
        if bare != t and luhn(digits):
            out.append("c=groups")
    if _IBAN.fullmatch(bare):
        out.append("iban=" + str(iban(bare)))
    if t[0] in "+(" and 8 <= n <= 15 and not re.search(r"[^\d+().\- ]", t):
        out += ["tel", "tel" + t[0]]
    letters = sum(c.isalpha() for c in t)
    kinds = [any(c.islower() for c in t), any(c.isupper() for c in t), n > 0, not t.isalnum()]
    if len(t) >= 12 and letters and n or letters >= CAPS:
        kind = "hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", t) else "caps" if re.fullmatch(r"[0-9A-Z]+", t) else "mix" if re.fullmatch(r"[\w\-./+]+", t) else "odd"
        out += [f"k={kind}", f"k={kind}{min(len(t) // 4, 12)}", f"pre={t[:4]}" if kind == "caps" else f"pre={t[:3]}"]
        if key:
            out.append("key+long")
    if key:
        out += ["key", "key+mixed" if letters and n else "key+plain", f"key+{sum(kinds)}"]
        if key["sign"]:
            named = "pass" if key["pass"] else "name"
            out += [f"{named}{key['sign']}", f"{named}{key['sign']}{'mixed' if sum(kinds) > 1 else 'digits' if n else 'word'}"]
            if key["quote"]:
                out.append("key+quote")
    return out


def same_key(t: str) -> str:
    return re.sub(r"[\W_]+", "", t).lower()


class Nodes:
    """Pieces of documents with their chain edges and the mentions of each key, gathered for one inference."""

    def __init__(self) -> None:
        self.doc: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.text: list[str] = []
        self.feats: list[list[str]] = []
        self.chain: list[tuple[int, int]] = []
        self.mentions: dict[tuple[int, str], list[int]] = {}

    def piece(self, doc: int, span: tuple[int, int], text: str, feats: list[str], joined: bool) -> None:
        i = len(self.text)
        self.doc.append(doc)
        self.span.append(span)
        self.text.append(text)
        self.feats.append(feats)
        if joined:
            self.chain.append((i - 1, i))
        if len(k := same_key(text)) > 3:
            self.mentions.setdefault((doc, k), []).append(i)

    def field(self, skip: bool = True) -> tuple[list[list[str]], np.ndarray, list[list[int]]]:
        """(features of all variables, edges, mentions of each hub): pieces first, then a hub for each key of several mentions.

        A hub has the features of all its mentions, each once, and they have none of their own.
        """
        hubs = [m for m in self.mentions.values() if len(m) > 1] if skip else []
        feats, edges, n = list(self.feats), [(a, b, CHAIN) for a, b in self.chain], len(self.text)
        for h, own in enumerate(hubs):
            feats.append(list(dict.fromkeys(f for i in own for f in self.feats[i])))
            for i in own:
                feats[i] = []
                edges.append((i, n + h, SKIP))
        return feats, np.array(edges, dtype=np.int64).reshape(-1, 3), hubs


def candidates(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(start, end, document) of the words, as white space cuts them, that may hold a piece; and the spans behind key words."""
    start, end, first = words(raw, off, spaced=True)
    count = lambda table, at: (lambda acc: acc[end[at]] - acc[start[at]])(np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)]))
    every = np.arange(len(start))
    some = (count(_DIGIT_AT, every) > 0) | (count(_COLON, every) > 1)
    long = np.flatnonzero(~some & (end - start >= CAPS))
    if len(long):
        some[long] = count(_UPPER, long) >= CAPS
    values = []
    data, at = raw.tobytes(), 0
    while m := _SIGN.search(data, at):
        d = int(np.searchsorted(off, m.start(), side="right")) - 1
        hi = int(off[d + 1])
        # nothing reaches from one text into the next
        at = min(m.end(), hi)
        if m.end() >= hi or m.start() > off[d] and _letter(data[m.start() - 1]) or not (v := _VALUE.match(data, m.end(), hi)):
            continue
        a, b = v.span()
        while b > a and data[b - 1] in b".,;:!?)]}%&$#*":
            b -= 1
        if b > a:
            values.append((a, b))
    values = _again(raw, off, values)
    some[np.searchsorted(start, np.array([a for a, _ in values], dtype=np.int64), side="right") - 1] = True
    at = np.flatnonzero(some)
    return start[at], end[at], np.searchsorted(first, at, side="right") - 1, values


def _again(raw: np.ndarray, off: np.ndarray, values: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans behind key words, and all other places where the same value stands by itself in that document."""
    by: dict[int, dict[bytes, None]] = {}
    for a, b in values:
        if b - a > 3:
            by.setdefault(int(np.searchsorted(off, a, side="right")) - 1, {})[raw[a:b].tobytes()] = None
    out = set(values)
    for d, known in by.items():
        find = ahocorasick.Automaton()
        for v in known:
            find.add_word(v.decode("latin-1"), len(v))
        find.make_automaton()
        lo, data = int(off[d]), raw[off[d] : off[d + 1]].tobytes()
        for last, size in find.iter(data.decode("latin-1")):
            a, b = last + 1 - size, last + 1
            if not (a and (_letter(data[a - 1]) or data[a - 1 : a].isdigit()) or b < len(data) and (_letter(data[b]) or data[b : b + 1].isdigit())):
                out.add((lo + a, lo + b))
    # where two begin at one place the longer counts
    return sorted(out, key=lambda x: (x[0], -x[1]))


def _letter(b: int) -> bool:
    return b >= 128 or 65 <= b <= 90 or 97 <= b <= 122


def _around(data: bytes, lo: int, hi: int, a: int, b: int) -> tuple[str, str]:
    """The text shortly before a and after b, within lo and hi; words at its ends are whole."""
    x, y = max(lo, a - WINDOW), min(hi, b + WINDOW)
    while x > lo and _letter(data[x]) and _letter(data[x - 1]):
        x -= 1
    while y < hi and _letter(data[y]) and _letter(data[y - 1]):
        y += 1
    return data[x:a].decode(errors="ignore"), data[b:y].decode(errors="ignore")


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    for m in _PIECE.finditer(text):
        a, b = m.span()
        if m["simple"] is None and ":" in m.group() and not is_ipv6(m.group()):
            yield from ((a + x.start(), a + x.end()) for x in _SIMPLE.finditer(m.group()))
        else:
            yield a, b


def gather(text: pa.Array) -> tuple[Nodes, np.ndarray, np.ndarray]:
    """Nodes of all texts; spans are byte offsets into the buffer, which is returned with the texts' offsets."""
    raw, off = text_buffer(text)
    nodes = Nodes()
    start, end, doc, values = candidates(raw, off)
    data = raw.tobytes()
    # words with nothing but blanks between them are read together
    runs: list[list[int]] = []
    for s, e, d in zip(start.tolist(), end.tolist(), doc.tolist()):
        if runs and runs[-1][2] == d and not data[runs[-1][1] : s].strip(b" \t"):
            runs[-1][1] = e
        else:
            runs.append([s, e, d])
    k, prev = 0, [-1, -1, -1]
    for s, e, d in runs:
        close = d == prev[2] and not data[prev[1] : s].strip(b" \t\n\r\x0b\x0c")
        prev = [s, e, d]
        lo, hi = int(off[d]), int(off[d + 1])
        # spans behind key words are pieces as they are; the rest is cut up
        parts, at = [], s
        while k < len(values) and values[k][0] < e:
            a, b = values[k]
            k += 1
            if a >= at:
                parts += [(at, a, False), (a, min(b, e), True)]
                at = min(b, e)
        parts.append((at, e, False))
        for a, b, whole in parts:
            t = data[a:b].decode(errors="ignore")
            plain = len(t) == b - a
            for x, y in [(0, len(t))] if whole else _pieces(t):
                piece = t[x:y]
                if not (whole or any("0" <= c <= "9" or c == "@" for c in piece) or sum("A" <= c <= "Z" for c in piece) >= CAPS or is_ipv6(piece)):
                    close = False
                    continue
                i, j = (a + x, a + y) if plain else (a + len(t[:x].encode()), a + len(t[:y].encode()))
                nodes.piece(d, (i, j), piece, features(piece, *_around(data, lo, hi, i, j)), close)
                close = True
    return nodes, raw, off


def logsumexp(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None, :]).sum(1))


def propagate(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, passes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(log-marginals of nodes, log-marginals (E, L, L) of edges) by sum-product messages; exact without loops.

    passes: rounds of all messages; None: until they no longer change.
    """
    n, e = len(unary), len(edges)
    norm = lambda x: x - (x.max(1, keepdims=True) + np.log(np.exp(x - x.max(1, keepdims=True)).sum(1, keepdims=True)))
    if not e:
        return norm(unary), np.zeros((0, L, L), unary.dtype)
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pots = pair[edges[:, 2]]
    order = np.argsort(dst, kind="stable")
    node, first = np.unique(dst[order], return_index=True)
    msg = np.zeros((2 * e, L), unary.dtype)
    both_ways = np.concatenate([pots, pots.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    live = np.arange(2 * e)
    for k in range(MOST if passes is None else passes):
        belief = unary.copy()
        belief[node] += np.add.reduceat(msg[order], first, axis=0)
        out = belief[src[live]] - msg[back[live]]
        new = logsumexp(out[:, :, None] + both_ways[live])
        new -= new.max(1, keepdims=True)
        step = min(0.5, 0.5 * STEADY / k) if k else 1.0
        gap = np.abs(new - msg[live]).max(1)
        msg[live] += step * (new - msg[live])
        if passes is None:
            # a message may change if it has not settled, or one that comes into its source has changed
            moved = live[gap > TOLERANCE]
            if not len(moved):
                break
            stir = np.zeros(n, bool)
            stir[dst[moved]] = True
            again = stir[src]
            again[moved] = True
            live = np.flatnonzero(again)
    belief = unary.copy()
    belief[node] += np.add.reduceat(msg[order], first, axis=0)
    both = (belief[edges[:, 0]] - msg[e:])[:, :, None] + pots + (belief[edges[:, 1]] - msg[:e])[:, None, :]
    flat = both.reshape(e, -1)
    return norm(belief), norm(flat).reshape(both.shape)


class Model:
    """Weights of features (rows of a matrix) and of edges by kind."""

    def __init__(self, index: dict[str, int], weight: np.ndarray, pair: np.ndarray):
        self.index, self.weight, self.pair = index, weight, pair

    def rows(self, feats: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(places, node of each place); features that training never saw count nothing."""
        get = self.index.get
        place = [[p for f in fs if (p := get(f)) is not None] for fs in feats]
        return np.array([p for ps in place for p in ps], dtype=np.int64), np.repeat(np.arange(len(feats)), [len(p) for p in place])

    def unary(self, place: np.ndarray, node: np.ndarray, n: int) -> np.ndarray:
        w = self.weight[place]
        return np.stack([np.bincount(node, weights=w[:, k], minlength=n) for k in range(L)], axis=1)

    def label(self, nodes: Nodes, skip: bool = True) -> np.ndarray:
        """Labels of the pieces; without skip each is judged by itself and its neighbours."""
        if not nodes.text:
            return np.zeros(0, np.int64)
        feats, edges, _ = nodes.field(skip)
        return propagate(self.unary(*self.rows(feats), len(feats)), edges, self.pair)[0][: len(nodes.text)].argmax(1)


def examples(n: int, seed: int) -> list[list[tuple[str, int]]]:
    """Texts as lists of (words, label), written by rule from a seed."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 9)))
    num = lambda a, b=None: "".join(r.choice(string.digits) for _ in range(r.randint(a, b or a)))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    base = lambda k, a=string.ascii_letters + string.digits: "".join(r.choice(a) for _ in range(k))

    def card() -> str:
        s = r.choice("3456") + num(14)
        s += next(c for c in string.digits if luhn(s + c))
        return s if r.random() < 0.7 else r.choice("- ").join(s[i : i + 4] for i in range(0, 16, 4))

    def unpaid() -> str:
        """Digits like a card's whose checksum is wrong."""
        s = num(15)
        return s + r.choice([c for c in string.digits if not luhn(s + c)])

    def phone() -> str:
        a, b, c = r.choice("23456789") + num(2), num(3), num(4)
        return r.choice((f"+{num(2)} {num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"+{num(2)} {num(3)} {num(6, 7)}", f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {num(2, 3)} {num(3)} {num(4)}", f"+{num(11)}", f"+{num(1, 2)}-{a}-{b}-{c}"))

    def email() -> str:
        return word() + r.choice((f".{num(2)}", "", f".{word()}", f"_{num(1)}", f"+{word()}")) + "@" + word() + r.choice(("", num(1))) + "." + r.choice(("example.com", "com", "org", "co.uk", "de", "net"))

    def ip() -> str:
        return ".".join(map(str, r.choice(([r.randint(0, 255) for _ in range(4)],) * 4 + ([10, 0, r.randint(0, 9), r.randint(0, 255)], [192, 168, r.randint(0, 255), r.randint(0, 255)]))))

    def ipv6() -> str:
        k = r.randint(2, 6)
        return r.choice((":".join(hexes(r.randint(1, 4)) for _ in range(8)), ":".join(hexes(4) for _ in range(k)) + "::" + hexes(r.randint(1, 4))))

    def account() -> str:
        """An account number with its checksum, in groups or not."""
        land, body = r.choice(("DE", "FR", "GB", "ES", "IT", "NL", "CH")), num(r.choice((12, 14, 18, 18, 20)))
        t = f"{land}{98 - int(''.join(str(int(c, 36)) for c in body + land + '00')) % 97:02d}{body}"
        return t if r.random() < 0.5 else " ".join(t[i : i + 4] for i in range(0, len(t), 4))

    def password() -> str:
        return r.choice((word() + word(), word() + num(1, 4), word() + r.choice("!?@#$_-") + num(1, 3), "".join(r.choice((c, c, c.upper(), {"a": "@", "o": "0", "s": "$", "e": "3"}.get(c, c))) for c in word() + word()), base(r.randint(8, 16), string.ascii_letters + string.digits + "!@#$%^&*")))

    def secret() -> tuple[str, str]:
        """(words before, secret)"""
        k = r.random()
        if k < 0.3:
            return r.choice(("", word() + " ", "aws_access_key_id = ")), r.choice(("AKIA", "AKIA", "ASIA")) + base(16, string.ascii_uppercase + r.choice(("", "234567", string.digits)))
        if k < 0.4:
            return "", r.choice(("ghp_", "sk-", "sk_live_", "xoxb-")) + base(r.choice((24, 36, 40)))
        if k < 0.6:
            return r.choice(("password", "passwd", "pwd", "Password", "passphrase", "db_password")) + r.choice(("=", ": ", " = ", ' = "', "='", ":")), password()
        s = r.choice((hexes, base))(r.randint(12, 64))
        name = r.choice(("token", "api_key", "secret", "apikey", "api-key", "auth_token", "client_secret", "credentials", "password"))
        return r.choice((f'{name} = "', f"{name} = '", f"{name}=", f"{name}: ", f'"{name}": "', "key: ", "Bearer ", "key=")), s

    def ident() -> tuple[str, str]:
        return r.choice((("", f"{num(3)}-{num(2)}-{num(4)}"), ("ssn ", f"{num(3)}-{num(2)}-{num(4)}"), ("iban ", account()), ("", account()), ("", r.choice(("DE", "FR", "ES")) + num(20))))

    def other() -> tuple[str, str]:
        return r.choice((
            lambda: ("", num(1, 4)), lambda: ("", f"{num(1)}.{num(1)}"), lambda: ("", f"{num(1)}."), lambda: ("", f"{r.randint(1900, 2035)}-{num(2)}-{num(2)}"),
            lambda: ("", f"{num(2)}:{num(2)}"), lambda: ("$", f"{num(1, 3)},{num(3)}.{num(2)}"), lambda: ("version ", r.choice((ip(), f"{num(1)}.{num(1)}.{num(1)}"))),
            lambda: ("", f"{num(1)}.{num(1)}.{num(1)}"), lambda: (r.choice(("order ", "no. ", "article ", "id ", "#")), num(5, 18)), lambda: ("", r.choice("12789") + num(r.choice((12, 14, 15)))), lambda: ("", unpaid()), lambda: ("", unpaid()),
            lambda: ("isbn ", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}"), lambda: ("", f"{word()}{num(1, 4)}"), lambda: ("", f"@{word()}{num(0, 2)}"), lambda: ("", f"{num(1, 2)}/{num(1, 2)}/{num(2, 4)}"),
            lambda: (r.choice(("commit ", "sha1 ", "md5 ", "revision ", "checksum: ", "blob ")), hexes(r.choice((40, 32, 64)))), lambda: ("", base(4, string.ascii_uppercase) + num(2, 6)),
            lambda: ("", f"{num(1, 3)}%"), lambda: ("", f"{num(2, 3)}-{num(2, 3)}"), lambda: ("key ", num(1, 3)), *[lambda: ("", base(r.randint(16, 30), string.ascii_uppercase + r.choice(("", "ÄÖÉÈ"))))] * 3,
            lambda: ("", f"{num(1)}.{num(1)}.{num(1)}.{num(1)}.{num(1)}"), lambda: ("page ", num(1, 3)), lambda: ("", f"({num(1, 4)})"), lambda: ("", f"{r.randint(256, 999)}.{num(3)}.{num(3)}.{num(3)}"),
            lambda: (r.choice(("token: ", "secret: ", "the key: ", "the password ", "tokens: ", "keys: ", "pass: the ", "a token = ")), word() if r.random() < 0.7 else num(1, 3)), lambda: ("", f"{num(2)}:{num(2)}:{num(2)}"), lambda: ("", ":".join(hexes(2) for _ in range(6))),
            lambda: ("", " ".join(num(4) for _ in range(r.choice((2, 3, 5))))), lambda: ("", f"+{num(1, 3)}"), lambda: ("uuid ", f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}"), lambda: ("", f"{num(1, 3)} {num(1, 3)} {num(1, 3)}"),
        ))()

    out = []
    for _ in range(n):
        seen: list[tuple[str, str, int]] = []
        for _ in range(r.randint(1, 5)):
            k = r.randint(1, 12)
            pre, t = {1: lambda: ("", email()), 2: lambda: ("", phone()), 3: lambda: ("", ip() if r.random() < 0.7 else ipv6()), 4: lambda: ("", card()), 5: secret, 6: ident}.get(k, other)()
            seen.append((pre, t, k if k < 7 else 0))
        # later mentions lack the words that tell what the first one is
        again = [(r.choice(("", "", word() + " ")), x[1], x[2]) for x in seen if r.random() < 0.4 for _ in range(r.choice((1, 1, 2, 6)))]
        text: list[tuple[str, int]] = []
        for pre, t, k in seen + again:
            text.append((" ".join(word() for _ in range(r.choice((0, 1, 3, 6)))) + r.choice((" ", " ", "\n", ". ")) + pre, 0))
            junk = "" if r.random() < 0.4 else r.choice((".", ",", ")", r.choice(string.punctuation.translate({ord(c): None for c in "-+@/_.:"})) * r.randint(1, 4)))
            text += [(t, k), ((pre[-1] if pre.endswith(('"', "'")) else "") + junk + " " + r.choice(("", word() + " ")), 0)]
        out.append(text)
    return out


def training_set(n: int, seed: int) -> tuple[Nodes, np.ndarray]:
    """Nodes of the examples and their labels."""
    texts, spans = [], []
    for parts in examples(n, seed):
        at, own = 0, []
        for t, k in parts:
            b = len(t.encode())
            own.append((at, at + b, k))
            at += b
        texts.append("".join(t for t, _ in parts))
        spans.append(own)
    nodes, _, off = gather(pa.array(texts))
    y = np.zeros(len(nodes.text), dtype=np.int64)
    for i, (d, (a, b)) in enumerate(zip(nodes.doc, nodes.span)):
        y[i] = next((k for s, e, k in spans[d] if k and s < b - off[d] and a - off[d] < e), 0)
    return nodes, y


@lru_cache(maxsize=1)
def train(n: int = N_TRAIN, seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam over all examples; expectations are those of belief propagation."""
    nodes, y = training_set(n, seed)
    feats, edges, hubs = nodes.field()
    # a hub is what its mentions are
    y = np.concatenate([y, np.array([np.bincount(y[m], minlength=L).argmax() for m in hubs], dtype=np.int64)])
    count: dict[str, int] = {}
    for fs in feats:
        for f in fs:
            count[f] = count.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, c in count.items() if c > 2))}
    m = Model(index, np.zeros((len(index), L)), np.zeros((2, L, L)))
    place, node = m.rows(feats)
    size, gold = len(y), np.eye(L)[y]
    gold_pair = np.zeros((2, L, L))
    np.add.at(gold_pair, (edges[:, 2], y[edges[:, 0]], y[edges[:, 1]]), 1)
    state = [np.zeros_like(x) for x in (m.weight, m.weight, m.pair, m.pair)]
    for t in range(1, epochs + 1):
        one, two = propagate(m.unary(place, node, size), edges, m.pair, 6)
        gap = gold - np.exp(one)
        g_w = np.stack([np.bincount(place, weights=gap[node, k], minlength=len(index)) for k in range(L)], axis=1) - 0.2 * m.weight
        expected = np.stack([np.exp(two[edges[:, 2] == k]).sum(0) for k in (CHAIN, SKIP)])
        g_p = gold_pair - expected - 0.2 * m.pair
        # one weight for agreement, the same for all labels: a mention that knows nothing tells its hub nothing, however many there are
        g_p[SKIP] = np.eye(L) * (np.trace(g_p[SKIP]) / L)
        for x, g, a, b in ((m.weight, g_w, *state[:2]), (m.pair, g_p, *state[2:])):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            x += 0.15 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-6)
    return m


def entities(text: pa.Array, model: Model) -> tuple[list[list[tuple[int, int, str]]], np.ndarray, np.ndarray]:
    """For each text the (start, end, label) of its entities, in bytes of that text; the buffer and the offsets."""
    nodes, raw, off = gather(text)
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(text))]
    chained = {b for _, b in nodes.chain}
    last = -2
    labels = model.label(nodes)
    for i in np.flatnonzero(labels > 0).tolist():
        d, (a, b), name = nodes.doc[i], nodes.span[i], LABELS[labels[i]]
        a, b = a - int(off[d]), b - int(off[d])
        # a phone number may be several pieces
        if name == "PHONE" and i == last + 1 and i in chained and out[d] and out[d][-1][2] == "PHONE":
            out[d][-1] = (out[d][-1][0], b, name)
        else:
            out[d].append((a, b, name))
        last = i
    return out, raw, off


def _redacted(data: bytes, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, name in found:
        parts += [data[at:a], f"<{name}>".encode()]
        at = b
    return b"".join([*parts, data[at:]]).decode()


def _in_characters(data: bytes, found: list[tuple[int, int, str]]) -> list[dict]:
    out, at, chars = [], 0, 0
    for a, b, name in found:
        chars += len(data[at:a].decode())
        end = chars + len(data[a:b].decode())
        out.append({"start": chars, "end": end, "label": name})
        at, chars = b, end
    return out


def _each(text: pa.Array, model: Model, most: int = 1 << 21) -> Iterator[tuple[int, bytes, list[tuple[int, int, str]]]]:
    """(row, bytes, entities) of the texts that have any."""
    for i, j in blocks(np.diff(text_buffer(text)[1]), most):
        found, raw, off = entities(text.slice(i, j - i), model)
        for k, f in enumerate(found):
            if f:
                yield i + k, raw[off[k] : off[k + 1]].tobytes(), f


def find(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_entities, entities, text) of the documents that hold personal data or secrets; text is redacted."""
    held = docs.sparkSession.sparkContext.broadcast(train())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
        for b in it:
            rows = [(k, len(f), _in_characters(t, f), _redacted(t, f)) for k, t, f in _each(b.column(1), held.value)]
            at, n, found, text = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(text, pa.string())], names=["doc_id", "n_entities", "entities", "text"])

    slim = docs.select(docs[id_col].try_cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_entities long, entities array<struct<start:long,end:long,label:string>>, text string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, with <LABEL> for each entity of the text; n_chars, where there is one, counts the new text."""
    held = docs.sparkSession.sparkContext.broadcast(train())
    place = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(place).to_pylist()
            for k, t, f in _each(b.column(place), held.value):
                texts[k] = _redacted(t, f)
            cols = list(b.columns)
            cols[place] = pa.array(texts, b.column(place).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
