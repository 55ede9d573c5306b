"""Secret scans: fixed patterns, and a linear-chain CRF decoded by Viterbi for what they miss.

A chain is the tokens of a whole text: every token gets its score and its tag, whatever stands near it.  Features
are the token's shape, the neighbouring words and marks, the last cue and how far it lies back, whether a key block is open, and
features of the whole file (document).  ``chain_features`` names them for the training; ``Scorer`` adds up their
weights from tables for all tokens of a text at once, and only stretches that a bound doesn't rule out go through Viterbi.

The model is trained here, on seeded generated lines (``TRAIN_LINES``): nothing labels secrets in
the corpus.  Training is the same for every input, so the result doesn't depend on the input size.

Defined results: null text counts as empty; empty texts have no span; long texts are scanned
whole; repeated rows give repeated results; extra columns are ignored, and kept by ``redacted``.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship

#: The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

MIN_OPEN, CUE_REACH = 16, 6
#: Kept tokens with their types, and the longest text between tokens that is kept, per task.
MAX_TYPES, MAX_GAP = 1 << 18, 32
TRAIN_LINES, EPOCHS = 3200, 5
#: The words that announce a secret, and long tokens with a digit.
TRIGGER = re.compile(r"passw(?:or)?d|passphrase|passcode|\bpwd\b|secret|token|api[ _-]?key|bearer|authorization|credential|private[ _]key|access[ _]key|login|mot\s+de\s+passe|kennwort|passwort|\bclave\b|contrase[nñ]a|\b(?:pass|key)\x20?[:=]|://[^\s/:@]{1,64}:[^\s/@]{1,256}@", re.I)
OPEN = re.compile(rf"(?<![A-Za-z0-9+/_.~-])(?=[A-Za-z+/_.~-]*[0-9])[A-Za-z0-9+/_.~-]{{{MIN_OPEN},}}")
TOKEN = re.compile(r"[^\s\"'`,;:=()\[\]{}<>|\\]+")
PIECES = re.compile(f"({TOKEN.pattern})")
O, B, I = 0, 1, 2
#: Score of what cannot be: I follows B or I only.
FORBIDDEN = -1e9
CUES = frozenset("passe kennwort passwort clave contrasena password passwd passphrase passcode secret token key apikey api_key bearer authorization auth credential credentials private access pwd pass login session jwt begin sha commit md digest checksum hash id card phone tel number version uuid order ref ip date invoice isbn serial".split())
#: Words whose neighbourhood counts by name; other words count by their shape.
NEAR = CUES | frozenset("est ist es le la das der die de el mot is was are be to the a an of with for as use my your our new set and or in on at by from not no must has have it this that see".split())
#: A key block's first and last line.
BEGIN, END = "-----BEGIN ", "-----END "
ONE_WORD_LINES = re.compile(r"(?:\r?\n[ \t>#]*+[^\s>#]\S*+[ \t]*+(?=\r?\n|\Z))*+")
PREFIX = re.compile(r"ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk_test_|sk-|pk_live_|rk_live_|eyJ|AIza|ya29\.|SG\.|npm_|hf_|dop_v1_|MII")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def shape(tok: str) -> str:
    if tok.isalpha():
        if not tok.isascii():
            return "word"
        return "lower" if tok.islower() else "upper" if tok.isupper() else "title" if tok[1:].islower() else "mixedletters"
    if tok.isdigit():
        return "digits"
    if len(tok) > 256:  # nothing below is for long ones
        return "base64" if re.fullmatch(r"[A-Za-z0-9+/=]+", tok) else "joined"
    if re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", tok, re.I):
        return "uuid"
    if re.fullmatch(r"[0-9.,:/_$%#*-]+", tok):
        return "numeric"
    if not any(map(str.isalnum, tok)):
        return "marks"
    if re.fullmatch(r"[^@]+@[^@]+\.[A-Za-z.]+", tok):
        return "mail"
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", tok):
        return "hex"
    if re.fullmatch(r"[A-Za-z0-9]+", tok):
        return ("lower" if tok.islower() else "upper" if tok.isupper() else "mixed") + "alnum"
    if re.fullmatch(r"[\W_]*[^\W\d_]+[\W_]*", tok):
        return "markedword"
    if re.fullmatch(r"[a-z]+(?:[._/'-][a-z0-9]{1,12})+", tok):
        return "joinedwords"
    if re.search(r"[!#$%&*^@?]", tok):
        return "withmarks"
    if re.fullmatch(r"[A-Za-z0-9+/]+", tok) or "+" in tok:
        return "base64"
    return "dotted" if "." in tok else "path" if "/" in tok else "joined"


def entropy(tok: str) -> float:
    n = len(tok)
    return -sum(c / n * math.log2(c / n) for c in Counter(tok).values())


def own_features(tok: str, kind: str) -> list[str]:
    n = len(tok)
    if kind in ("lower", "title", "word", "marks", "markedword"):  # nearly all tokens
        return [f"own={kind}|{min(n // 6, 9)}"]
    longest = max(map(len, re.split(r"[._/~+=-]+", tok)))
    flips = sum((a.isdigit() != b.isdigit()) or (a.islower() and b.isupper()) for a, b in zip(tok, tok[1:]))
    return [
        f"len={min(n // 8, 9)}", f"own={kind}|{min(n // 6, 9)}", f"piece={min(longest // 6, 6)}", f"flips={min(flips // 2, 8)}", f"flips={min(flips // 2, 8)}|{kind}",
        f"entropy={round(entropy(tok) * 2)}", f"prefix={bool(PREFIX.match(tok))}", f"digits={min(sum(map(str.isdigit, tok)) * 8 // n, 7)}",
    ]


def gap_class(gap: str) -> str:
    marks = "".join(gap.split())
    return "line" if "\n" in gap and not marks else "space" if not marks else marks[0] if len(marks) == 1 else marks[:2] if len(marks) == 2 else "marks"


def cue_of(word: str) -> str | None:
    """The last cue among a token's pieces."""
    parts = [p for p in re.split(r"[^a-z]+", word.lower().replace("\u00f1", "n")) if p in CUES]
    return parts[-1] if parts else None


def block_states(text: str, tokens: list[tuple[int, int]]) -> list[str]:
    """Of each token: out of a key block, in its first line (head) or in it."""
    out, block, ranges, at = [], "out", key_blocks(text), 0
    for a, b in tokens:
        while at < len(ranges) and a >= ranges[at][1]:
            at, block = at + 1, "out"
        if at == len(ranges):
            break
        if text.startswith(END.strip(), a):
            block = "out"
        out.append(block)
        block = "head" if text.startswith(BEGIN.strip(), a) and a >= ranges[at][0] else "in" if block == "head" and text.endswith("-----", a, b) else block
    return out + ["out"] * (len(tokens) - len(out))


def chain_features(text: str, tokens: list[tuple[int, int]], file: list[str]) -> list[list[str]]:
    """The features of each token of a chain."""
    words = [text[a:b] for a, b in tokens]
    kinds = [shape(w) for w in words]
    names = [low if (low := w.lower()) in NEAR else kind for w, kind in zip(words, kinds)]
    gaps = ["begin", *(gap_class(text[a[1] : b[0]]) for a, b in zip(tokens, tokens[1:])), "end"]
    out, cue, since = [], "none", 0
    for k, (word, kind, block) in enumerate(zip(words, kinds, block_states(text, tokens))):
        since += 1
        # a login of an address: //name:secret@host
        login = k > 0 and words[k - 1].startswith("//") and "@" in word and gaps[k] == ":"
        near = cue if since <= CUE_REACH else "none"
        before, after = names[k - 1] if k else "begin", names[k + 1] if k + 1 < len(names) else "end"
        out.append([
            "bias", f"shape={kind}", *own_features(word, kind), f"gap={gaps[k]}", f"gap={gaps[k]}|{kind}", f"then={gaps[k + 1]}", f"before={before}", f"before={before}|{kind}", f"after={after}", f"two={names[k - 2] if k > 1 else 'begin'}",
            f"cue={near}", f"cue={near}|{kind}", f"far={min(since, CUE_REACH + 1) if near != 'none' else 0}|{kind}", f"known={names[k] if names[k] != kind else ''}", f"block={block}", f"block={block}|{kind}", f"login={login}", *file,
        ])
        if found := cue_of(word):
            cue, since = found, 0
    return out


def file_features(text: str) -> list[str]:
    n = len(text) + 1
    return [f"file.size={min(int(math.log2(n)) // 3, 6)}", f"file.code={sum(map(text.count, '{};=')) * 200 > n}", f"file.pem={'-----BEGIN' in text}"]


def segments(text: str) -> list[tuple[int, int]]:
    """The stretches of a text that are looked at: all of it."""
    return [(0, len(text))] if text else []


def key_blocks(text: str) -> list[tuple[int, int]]:
    """From a BEGIN mark to the end of the next END mark's line, whatever the lines between hold; without END over the lines that follow and hold one word each."""
    out, at = [], text.find(BEGIN)
    while at >= 0:
        stop = text.find(END, at)
        line = text.find("\n", at if stop < 0 else stop)
        stretch = (at, len(text) if line < 0 else line)
        if stop < 0 and line >= 0:
            stretch = (at, ONE_WORD_LINES.match(text, line).end())
        out.append(stretch)
        at = text.find(BEGIN, stretch[1])
    return out


def bare_length(tok: str) -> int:
    """A token's length without a sentence's end and runs of one mark at its end; whole if it is nothing else."""
    b = len(tok)
    if tok[-1:].isalnum():
        return b
    while b:
        c = tok[b - 1]
        if c in ".?":
            b -= 1
        elif c in "!#$%&*~+-_" and b > 1 and tok[b - 2] == c:
            while b and tok[b - 1] == c:
                b -= 1
        else:
            return b
    return len(tok)


def tokens_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The tokens that begin in a stretch, whole; a sentence's end or a run of marks is no part of one, a base64 padding is."""
    out = []
    for m in TOKEN.finditer(text, start):
        a, b = m.span()
        if a >= end:
            break
        if a == start and a and TOKEN.match(text, a - 1):
            continue  # the rest of a token that begins before
        b = a + bare_length(m[0])
        if b - a >= MIN_OPEN and text[b : b + 1] == "=":
            pad = b + 1 + (text[b + 1 : b + 2] == "=")
            b = b if text[pad : pad + 1].isalnum() else pad
        out.append((a, b))
    return out


def chains(text: str) -> Iterator[list[tuple[int, int, list[str]]]]:
    """The chains of a text, each token with its features."""
    file = None
    for start, end in segments(text):
        if tokens := tokens_of(text, start, end):
            file = file_features(text) if file is None else file
            yield [(a, b, f) for (a, b), f in zip(tokens, chain_features(text, tokens, file))]


# --- training -----------------------------------------------------------------------------------


def _examples(seed: int = 20240229, lines: int = TRAIN_LINES) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Generated lines with the (start, end) of each secret's tokens, first one first."""
    rnd = random.Random(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = lower + lower.upper() + digits
    common = "the a of to in and is for on with this that from was are not by as at it".split()

    def some(chars: str, low: int, high: int) -> str:
        return "".join(rnd.choice(chars) for _ in range(rnd.randint(low, high)))

    def with_digit(make: object) -> str:
        while True:
            x = make()
            if any(c.isdigit() for c in x):
                return x

    def word() -> str:
        x = rnd.choice(common) if rnd.random() < 0.3 else some(lower + ("\u00e9\u00fc\u00f1" if rnd.random() < 0.2 else ""), 2, 9)
        return x.title() if rnd.random() < 0.15 else x

    def prose(low: int, high: int) -> str:
        return " ".join(word() + rnd.choice(["", "", "", "", "", ",", "."]) for _ in range(rnd.randint(low, high)))

    secrets = [
        lambda: "ghp_" + some(mixed, 36, 36), lambda: "sk_live_" + some(mixed, 24, 40), lambda: "xoxb-" + some(digits, 10, 12) + "-" + some(mixed, 20, 28),
        lambda: "eyJ" + some(mixed, 18, 30) + "." + some(mixed, 30, 60) + "." + some(mixed + "_-", 30, 50), lambda: "AIza" + some(mixed + "_-", 35, 35),
        lambda: some(mixed + "+/", 40, 40), lambda: some(mixed + "+/", 42, 86) + "==", lambda: some(digits + "abcdef", 32, 64), lambda: some(mixed, 20, 48), lambda: "glpat-" + some(mixed, 20, 22), lambda: "sk-" + some(mixed, 32, 48), lambda: some(lower + digits, 24, 40),
    ]
    announced = [
        lambda: some(lower, 4, 8) + some(digits, 1, 4), lambda: some(lower, 3, 7).title() + some(digits, 1, 3) + rnd.choice("!#$%&*"), lambda: some(lower, 2, 4).title() + some(digits, 1, 1) + some(lower, 2, 4) + some(digits, 1, 1) + some(lower, 1, 4) + rnd.choice(["", "&" + some(digits, 1, 2), "!"]),
        lambda: some(mixed, 8, 15), lambda: some(mixed + "!#$%&*@", 8, 16), lambda: some(lower + lower.upper(), 10, 32), lambda: "-".join(some(lower, 3, 8) for _ in range(4)), lambda: some(lower, 18, 32), lambda: some(lower.upper() + digits, 8, 15),
    ]
    plain = [
        lambda: some(digits, 16, 20), lambda: ".".join(some(digits, 1, 3) for _ in range(4)) + ":" + some(digits, 4, 5), lambda: f"{some(lower, 3, 8)}.{some(digits, 1, 2)}@mail{some(digits, 1, 1)}.example.com", lambda: "-".join(some(digits + "abcdef", n, n) for n in (8, 4, 4, 4, 12)), lambda: f"{some(lower, 3, 8)}.{some(lower, 3, 9)}{some(digits, 1, 2)}@{some(lower, 4, 8)}.org",
        lambda: "/".join([some(lower, 2, 9) for _ in range(rnd.randint(3, 5))] + [some(digits, 1, 5)]), lambda: f"20{some(digits, 2, 2)}-{some(digits, 2, 2)}-{some(digits, 2, 2)}T{some(digits, 2, 2)}", lambda: "-".join(some(digits, 4, 4) for _ in range(4)), lambda: f"+{some(digits, 1, 2)} ({some(digits, 3, 3)}) {some(digits, 3, 3)}-{some(digits, 4, 4)}",
        lambda: ".".join([some(lower, 2, 9), some(lower, 2, 9), some(lower, 2, 9), some(digits, 1, 2)]), lambda: "_".join([some(lower, 2, 9), some(lower, 2, 9), some(lower, 2, 9) + some(digits, 1, 3)]), lambda: some(lower, 6, 24) + some(digits, 1, 4), lambda: ".".join([some(lower, 2, 9), some(lower, 2, 9)]) + "/" + some(lower, 2, 9) + "/" + some(digits, 2, 4) + ".html", lambda: some(lower, 4, 16).upper() + "-" + some(digits, 4, 10),
        lambda: "www." + some(lower, 2, 9) + some(digits, 1, 2) + ".example.com", lambda: some("xX.-_", 10, 16) + some(digits, 1, 2) + some("x.-", 2, 8), lambda: "v" + ".".join(some(digits, 1, 2) for _ in range(3)) + "-" + some(lower, 2, 9) + "." + some(digits, 1, 3),
    ]
    good = ["token: ", "secret=", "password = \"", "api key ", "Authorization: Bearer ", "private key: ", "credentials ", "access token '", "key=", "auth: ", "export SECRET=", "pwd: "]
    naming = ["password is ", "my password is ", "the password: ", "password was ", "log in with password ", "pwd ", "passphrase: ", "passphrase is ", "use the secret ", "the api key is ", "api key: ", "token ", "set the token to ", "your passcode is ", "login token ", "secret key is ", "credentials: admin ", "credential ", "mot de passe : ", "le mot de passe est ", "mot de passe: ", "Kennwort: ", "das Passwort ist ", "Passwort: ", "clave: ", "la clave es ", "la contrase\u00f1a es ", "contrase\u00f1a: ", "pass: ", "pass = ", "key = ", "key: "]
    talk = [
        "the password is required", "password must be changed", "your password has expired", "reset the password for {}", "a secret {} of the {}", "the secret is out", "keep it secret from {}", "token of thanks", "a token is not needed", "the token expires on {}", "login is not possible {}", "login page of {}", "the api key is missing", "no credentials for {}", "bearer of {} news", "passwords are stored as hashes",
        "secretary of {}", "the private key is lost", "password and login for {}", "by {} token {} number", "the password was wrong", "secret {} to {}", "tokens {} in {}", "authorization is {} by {}", "la clave de {}", "una clave para {}", "das Kennwort ist {} falsch", "le mot de passe a {}", "la contrase\u00f1a no es {}", "the key: {} and {}", "see http://{}/{}",
    ]
    bad = ["card ", "phone ", "order ", "ref ", "ip ", "version ", "id ", "uuid: ", "isbn ", "see ", "at ", "invoice number ", "serial ", ""]
    for _ in range(lines):
        lead = prose(0, 6) + rnd.choice([" ", ". ", ", ", "\n", ""])
        tail = rnd.choice([" ", "\" ", ", ", ". ", "", "\n"]) + prose(0, 5)
        kind = rnd.random()
        if kind < 0.05:
            rows = [some(mixed + "+/", 64, 64) for _ in range(rnd.randint(1, 4))] + [some(rnd.choice([mixed + "+/", lower]), 4, 64) + rnd.choice(["", "=", "=="])]
            mark = rnd.choice(["", "", "  ", "> ", "# "])
            text, spans = lead + "\n" + mark + "-----BEGIN PRIVATE KEY-----\n", []
            for row in rows:
                spans.append((len(text) + len(mark), len(text) + len(mark) + len(row.rstrip("="))))
                text += mark + row + "\n"
            yield text + mark + "-----END PRIVATE KEY-----\n", spans
        elif kind < 0.07:
            head = lead + rnd.choice(["mysql", "postgres", "https", "amqp", "redis", "ftp"]) + "://" + some(lower, 3, 8) + ":"
            x = rnd.choice(announced)().replace("@", "") + "@" + rnd.choice(["host", "db", some(lower, 3, 8) + ".example.com", "localhost"])
            yield head + x + rnd.choice(["", ":5432", "/"]) + tail, [(len(head), len(head) + len(x))]
        elif kind < 0.3:
            head = lead + rnd.choice(good if rnd.random() < 0.7 else ["", "see ", "from ", "key "])
            x = with_digit(rnd.choice(secrets))
            yield head + x + tail, [(len(head), len(head) + len(x))]
        elif kind < 0.52:
            head = lead + (opening := rnd.choice(naming)) + ("'" if (quoted := rnd.random() < 0.2) else "")
            x = rnd.choice(announced)() if rnd.random() < 0.85 else with_digit(rnd.choice(secrets))
            yield head + x + ("'" if quoted else "") + tail, [(len(head), len(head) + len(x))] if opening else []
        elif kind < 0.74:
            yield lead + re.sub(r"\{\}", lambda m: word(), rnd.choice(talk)) + rnd.choice([" ", ". ", ", ", ""]) + prose(0, 8), []
        elif kind < 0.93:
            yield lead + rnd.choice(bad) + rnd.choice(plain)() + tail, []
        else:
            yield lead + rnd.choice(["commit ", "sha ", "md5 ", "checksum "]) + rnd.choice(plain[:4])() + " " + rnd.choice(plain)() + tail, []


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def tags_of(chain: list[tuple[int, int, list[str]]], secret: list[tuple[int, int]]) -> list[int]:
    """The true tags: a secret's first token begins it, its other tokens and those of its other lines are inside."""
    inside = [any(a < end and start < b for a, b in secret) for start, end, _ in chain]
    return [O if not x else I if k and inside[k - 1] else B for k, x in enumerate(inside)]


def train() -> dict:
    """Maximum conditional likelihood by AdaGrad over the chains; some seconds."""
    index: dict[str, int] = {}
    data = []
    for text, secret in _examples():
        for chain in chains(text):
            feats = [[index.setdefault(f, len(index)) for f in fs] for _, _, fs in chain]
            sizes = [len(f) for f in feats]
            data.append((np.array([i for f in feats for i in f]), np.repeat(np.arange(len(feats)), sizes), np.cumsum([0, *sizes[:-1]]), tags_of(chain, secret)))
    w, g2 = np.zeros((len(index), 3)), np.full((len(index), 3), 1e-3)
    t, t2 = np.zeros((3, 3)), np.full((3, 3), 1e-3)
    t[O, I] = FORBIDDEN
    rnd = random.Random(7)
    for _ in range(EPOCHS):
        rnd.shuffle(data)
        for flat, of, starts, tags in data:
            e = np.add.reduceat(w[flat], starts, axis=0)
            e[0, I] = FORBIDDEN
            n = len(tags)
            a, b = e.copy(), np.zeros((n, 3))
            for k in range(1, n):
                a[k] += _logsum(a[k - 1][:, None] + t, 0)
            for k in range(n - 2, -1, -1):
                b[k] = _logsum(t + (e[k + 1] + b[k + 1])[None, :], 1)
            z = _logsum(a[-1], 0)
            d = np.exp(a + b - z)
            d[np.arange(n), tags] -= 1
            step = d[of] + 1e-4 * w[flat]
            np.add.at(g2, flat, step**2)
            np.add.at(w, flat, -0.2 * step / np.sqrt(g2[flat]))
            if n > 1:
                q = np.exp(a[:-1, :, None] + t[None] + (e + b)[1:, None, :] - z)
                np.add.at(q, (np.arange(n - 1), tags[:-1], tags[1:]), -1)
                q = q.sum(axis=0)
                q[O, I] = 0
                t2 += q**2
                t -= 0.2 * q / np.sqrt(t2)
    return {"index": index, "w": w, "t": t}


@lru_cache(maxsize=1)
def default_model() -> dict:
    return train()


def viterbi(emissions: np.ndarray, t: np.ndarray) -> list[int]:
    best, back = emissions[0].copy(), []
    best[I] = FORBIDDEN
    for e in emissions[1:]:
        step = best[:, None] + t
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + e
    tags = [int(best.argmax())]
    for arrows in reversed(back):
        tags.append(int(arrows[tags[-1]]))
    return tags[::-1]


#: Every value of ``shape``.
KINDS_OF = ("word lower upper title mixedletters digits base64 joined uuid numeric marks mail hex loweralnum upperalnum mixedalnum markedword joinedwords withmarks dotted path").split()


class _Kept(dict):
    """Numbers of strings; ``make`` is asked once for each, but for strings over ``longest`` each time."""

    def __init__(self, make: Callable[[str], int], longest: int):
        super().__init__()
        self.make, self.longest = make, longest

    def __missing__(self, x: str) -> int:
        n = self.make(x)
        if len(x) <= self.longest:
            self[x] = n
        return n


class Scorer:
    """Scores of the tags B and I over O for all tokens of a text, by the model's weights.

    What a token adds by itself is worked out once for each type of token; what depends on its neighbours comes from tables
    by the classes of both, so the scores are the sums of the weights that ``chain_features`` names.
    """

    def __init__(self, model: dict):
        self.index, self.w = model["index"], model["w"][:, 1:] - model["w"][:, :1]
        t = model["t"] - model["t"][O, O]
        self.t = t
        #: What a tag B or I adds at most by the step into it, and by the step out of a secret.
        self.enter = np.array([t[:, B].max(), max(t[B, I], t[I, I])])
        self.leave = max(t[B, O], t[I, O], 0.0)
        self.kind_of = {k: n for n, k in enumerate(KINDS_OF)}
        self.name_of = {k: n for n, k in enumerate(dict.fromkeys([*KINDS_OF, "begin", "end", *sorted(NEAR)]))}
        self.cue_of = {c: n for n, c in enumerate(sorted(CUES))}
        # a class that training never met weighs nothing, and is one with any other
        gaps = sorted({f.split("=", 1)[1] for f in self.index if f.startswith("then=")} | {f.split("=", 1)[1].rsplit("|", 1)[0] for f in self.index if f.startswith("gap=") and f.endswith(tuple("|" + k for k in KINDS_OF))} | {"begin", "end", ":"})
        self.gap_of = {g: n + 1 for n, g in enumerate(gaps)}
        some, kinds = self.weight, KINDS_OF
        self.gap = np.concatenate([np.zeros((len(kinds), 2)), *([some(f"gap={g}", f"gap={g}|{k}") for k in kinds] for g in gaps)])
        self.then = np.array([np.zeros(2), *(some(f"then={g}") for g in gaps)])
        self.before = np.array([some(f"before={n}", f"before={n}|{k}") for n in self.name_of for k in kinds])
        self.after = np.array([some(f"after={n}") for n in self.name_of])
        self.two = np.array([some(f"two={n}") for n in self.name_of])
        far = [("none", 0), *((c, n) for c in self.cue_of for n in range(1, CUE_REACH + 1))]
        self.cued = np.array([some(f"cue={c}", f"cue={c}|{k}", f"far={n}|{k}") for c, n in far for k in kinds])
        self.block = {b: np.array([some(f"block={b}", f"block={b}|{k}") for k in kinds]) for b in ("out", "head", "in")}
        self.login = np.array([some(f"login={x}") for x in (False, True)])
        self.forget()

    def weight(self, *features: str) -> np.ndarray:
        return self.w[[self.index[f] for f in features if f in self.index]].sum(axis=0)

    def forget(self) -> None:
        """Begins with no types."""
        self.types, self.gaps = _Kept(self.type_of, 256), _Kept(lambda g: self.gap_of.get(gap_class(g), 0), MAX_GAP)
        self.known: dict[tuple, int] = {}
        self.own, self.traits = np.empty((1 << 12, 2)), np.empty((7, 1 << 12), np.int32)

    def type_of(self, raw: str) -> int:
        """The type of a token, up to the next mark: tokens alike in all that counts share one."""
        bare = bare_length(raw)
        word = raw[:bare]
        kind, low = shape(word), word.lower()
        cue = (low if low in CUES else None) if low.isalpha() and low.isascii() else cue_of(word)
        name = low if low in NEAR else kind
        # no key block is open and no login: where it is otherwise, the score is put right
        key = *own_features(word, kind), kind, name, cue, len(raw) - bare, bare >= MIN_OPEN, word.startswith("//"), "@" in word
        n = self.known.get(key)
        if n is None:
            n = self.known[key] = len(self.known)
            if n == len(self.own):
                self.own, self.traits = np.concatenate([self.own, np.empty_like(self.own)]), np.concatenate([self.traits, np.empty_like(self.traits)], axis=1)
            self.own[n] = self.weight("bias", f"shape={kind}", *key[:-7], f"known={name if name != kind else ''}") + self.login[0] + self.block["out"][self.kind_of[kind]]
            self.traits[:, n] = self.kind_of[kind], self.name_of[name], -1 if cue is None else self.cue_of[cue], *key[-4:]
        return n

    def scores(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(the tokens and what stands between them in turns, by how much each token's true end lies before its piece's, scores of B and I over O)."""
        pieces = PIECES.split(text)
        words, between = pieces[1::2], pieces[0::2]
        n = len(words)
        if not n:
            return pieces, np.empty(0, int), np.empty((0, 2))
        if len(self.types) > MAX_TYPES or len(self.known) > MAX_TYPES:
            self.forget()
        ids = np.fromiter(map(self.types.__getitem__, words), np.int64, n)
        gaps = np.fromiter(map(self.gaps.__getitem__, between), np.int64, n + 1)
        kind, name, cue, tail, long, slashes, at = self.traits.take(ids, 1)
        for k in np.flatnonzero(tail).tolist():
            # a sentence's end goes to what stands between
            gaps[k + 1] = self.gaps[words[k][-int(tail[k]) :] + between[k + 1]]
        trim = tail
        for k in np.flatnonzero(long & (tail == 0)).tolist():
            # a base64 padding is part of the token
            gap = between[k + 1]
            m = 1 + gap.startswith("==")
            if gap.startswith("=") and not (gap[m:] or "".join(words[k + 1 : k + 2]))[:1].isalnum():
                trim[k] = -m
                ids[k] = self.types[words[k] + gap[:m]]
                kind[k], name[k], cue[k], _, _, slashes[k], at[k] = self.traits[:, ids[k]]
                gaps[k + 1] = self.gaps[gap[m:]]
        gaps[0], gaps[n] = self.gap_of["begin"], self.gap_of["end"]
        names = np.empty(n + 3, np.int64)
        names[:2], names[2:-1], names[-1] = self.name_of["begin"], name, self.name_of["end"]
        kinds = len(KINDS_OF)
        e = self.own.take(ids, 0)
        e += self.gap.take(gaps[:-1] * kinds + kind, 0)
        e += self.then.take(gaps[1:], 0)
        e += self.before.take(names[1:-2] * kinds + kind, 0)
        e += self.after.take(names[3:], 0)
        e += self.two.take(names[:-3], 0)
        e += self.cued.take(kind, 0)
        e += self.weight(*file_features(text))
        cues = np.flatnonzero(cue >= 0).tolist()
        for p, q in zip(cues, [*cues[1:], n - 1]):
            # what follows a cue up to the next one
            near = np.arange(p + 1, min(p + CUE_REACH, q) + 1)
            e[near] += self.cued[(1 + cue[p] * CUE_REACH + near - p - 1) * kinds + kind[near]] - self.cued[kind[near]]
        if slashes.any():
            login = np.flatnonzero(slashes[:-1] & at[1:] & (gaps[1:-1] == self.gap_of[":"])) + 1
            e[login] += self.login[1] - self.login[0]
        if BEGIN in text:
            for k, block in enumerate(block_states(text, list(zip(*(x.tolist() for x in self.places(pieces, trim)))))):
                if block != "out":
                    e[k] += self.block[block][kind[k]] - self.block["out"][kind[k]]
        return pieces, trim, e

    @staticmethod
    def places(pieces: list[str], trim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the tokens."""
        stops = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        return stops[0::2][:-1], stops[1::2] - trim

    def tagged(self, e: np.ndarray) -> Iterator[tuple[int, int]]:
        """(token, tag) of the best sequence's tokens that aren't O.

        A secret is in the best sequence only if it doesn't lose against O; with the best steps into and out of each
        tag a token in no stretch of tokens that reaches that is O for certain.  What lies between such tokens is decoded by itself.
        """
        gain = np.maximum(e[:, 0] + self.enter[0], e[:, 1] + self.enter[1])
        if not len(e) or gain.max() < min(0.0, -self.leave - 1e-6):
            return
        total = np.cumsum(gain)
        ahead = np.maximum.accumulate(total[::-1])[::-1]
        behind = np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))
        maybe = np.flatnonzero(ahead - behind + self.leave >= -1e-6)
        for part in np.split(maybe, np.flatnonzero(np.diff(maybe) > 1) + 1) if len(maybe) else ():
            a, b = int(part[0]), int(part[-1]) + 1
            first = int(a > 0)
            rows = np.zeros((first + b - a + (b < len(e)), 3))
            rows[:, 1:] = FORBIDDEN
            rows[first : first + b - a, 1:] = e[a:b]
            for k, tag in enumerate(viterbi(rows, self.t)[first : first + b - a]):
                if tag != O:
                    yield a + k, tag


_scorer: tuple[dict, Scorer] | None = None


def scorer_of(model: dict) -> Scorer:
    """The tables of a model, made once a process."""
    global _scorer
    if _scorer is None or _scorer[0] is not model:
        _scorer = model, Scorer(model)
    return _scorer[1]


def crf_spans(text: str, model: dict) -> list[tuple[int, int]]:
    scorer = scorer_of(model)
    pieces, trim, e = scorer.scores(text)
    out: list[tuple[int, int]] = []
    if not (tags := list(scorer.tagged(e))):
        return out
    starts, ends = scorer.places(pieces, trim)
    for k, tag in tags:
        if tag == B:
            out.append((int(starts[k]), int(ends[k])))
        else:
            out[-1] = (out[-1][0], int(ends[k]))
    return out


def all_spans(text: str, model: dict) -> list[tuple[int, int, int]]:
    """Base spans, and what the CRF spans have outside of them."""
    base = base_spans(text)
    more = []
    for start, end in crf_spans(text, model):
        at = start
        for a, _, b in [*base, (end, 0, end)]:
            # white space at a piece's ends is no part of the secret
            if at < a <= end and (piece := text[at:a]).strip():
                more.append((at + len(piece) - len(piece.lstrip()), 3, at + len(piece.rstrip())))
            at = max(at, b) if a < end else at
    return sorted(base + more)


# --- Spark --------------------------------------------------------------------------------------

SCHEMA = "doc_id long, starts array<int>, ends array<int>, kinds array<string>, redacted string"


def find_secrets(docs: DataFrame, redact: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the spans (code points, end exclusive) and their kinds.

    With ``redact`` the whole text comes back too, each span (overlapping ones as one) replaced by
    that string; otherwise ``redacted`` is null.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(default_model())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                spans = all_spans(text or "", model.value)
                cols[0].append([s for s, _, _ in spans])
                cols[1].append([e for _, _, e in spans])
                cols[2].append([KINDS[k] for _, k, _ in spans])
                cols[3].append(None if redact is None or text is None else masked(text, spans, redact) if spans else text)
            types = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "starts", "ends", "kinds", "redacted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, SCHEMA)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of the ``op3`` query, from ``find_secrets``."""
    listed = F.arrays_zip("kinds", "starts", "ends")

    def joined(items):
        return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("kinds", lambda k: k == kind)).cast("long")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter(listed, lambda x: x["kinds"] != "crf")), 256).alias("base_sha256"), joined(listed).alias("spans"),
    )


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret's span replaced by ``mask`` in ``text``, and ``n_chars`` (if there) put right."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(default_model())
    text, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(text).to_pylist()
            new = [t and masked(t, all_spans(t, model.value), mask) for t in old]
            batch = batch.set_column(text, batch.schema.field(text), pa.array(new, batch.schema.field(text).type))
            if chars >= 0:
                n = [n if a == b else len(b) for n, a, b in zip(batch.column(chars).to_pylist(), old, new)]
                batch = batch.set_column(chars, batch.schema.field(chars), pa.array(n, batch.schema.field(chars).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
