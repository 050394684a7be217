"""Personal data: candidates from high-recall generators, scored by boosted trees.

Spans that satisfy a fixed format (email, ip, card, phone) are always found. Beyond these, generators
propose overlapping candidates far more loosely; trees for each kind judge them by their format (digits,
groups, checksum, entropy, ...) and their context (key words before, quotes, assignment), and a threshold
set on held-out candidates for high precision selects the spans to add. The trees are fitted on a bounded
sample of the corpus' own candidates together with seeded examples of the looser writings. A candidate of the
corpus is a positive where a fixed format or a known prefix of keys vouches for it, a negative where neither
format nor context speaks for it, and has no label where only one of them does. All positions are code points,
ends exclusive.
"""

from __future__ import annotations

import hashlib
import logging
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import boosting
from tidemark.llm.tables import seeded_sample

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Documents whose candidates may be fitted on, and candidates of them, at most.
TRAIN_DOCUMENTS, TRAIN_CANDIDATES = 20_000, 30_000
#: Precision on held-out candidates that a threshold must reach.
PRECISION = 0.99
#: Code points looked at before a candidate.
CONTEXT = 32

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ANY = re.compile(r"[0-9@]|[\[(]\s?at")

_LOOSE = {
    "email": (re.compile(r"(?<![^\s@<>()\"',;:])[^\s@<>()\"',;:]++@[^\s@<>()\"',;:]++"),
              re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[A-Za-z0-9-]{1,63})+")),
    "ip": (re.compile(r"(?<![0-9.])[0-9]{1,5}(?:\.[0-9]{1,5}){3}"),
           re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Fa-f:])")),
    "card": (re.compile(r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9])"),),
    "phone": (re.compile(r"(?<![0-9])\(?[0-9][0-9()\x20./-]{5,18}[0-9](?![0-9])"), re.compile(r"\+\s?[0-9][0-9()\x20./-]{5,18}[0-9](?![0-9])")),
    # a long run, in which only the padding at its end holds "="; the value that a telling name is given
    "secret": (re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}"),
               re.compile(r"(?i:passw(?:or)?d|passwd|pwd|passphrase|secret|token|api[_-]?key)[\"']?\s?[:=]\s?[\"']?([^\s\"',;<>]{6,}+)")),
}
#: Further runs after a secret, as in signed tokens.
_JOINED = re.compile(r"(?:\.[A-Za-z0-9_+/-]{16,}+={0,2})+")
#: Beginnings of keys of known services, and of signed tokens.
_PREFIX = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[0-9A-Za-z]{16}|sk[-_][0-9A-Za-z_-]{16}|xox[abprs]-[0-9A-Za-z-]{10}|AIza[0-9A-Za-z_-]{20}|eyJ[0-9A-Za-z_-]{16}")
#: Words that announce a kind.
_CUES = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "host", "addr", "server"),
    "card": ("card", "visa", "payment", "credit"),
    "phone": ("tel", "phone", "call", "fax", "mobile"),
    "secret": ("token", "key", "secret", "passw", "api", "auth", "credential", "bearer", "pwd"),
}
FEATURES = (
    "length", "digits", "letters", "uppers", "seps", "groups", "longest_group", "shortest_group", "plus", "bracket", "at", "dots",
    "tail_letters", "luhn", "octets", "entropy", "hex_share", "before_word", "after_word", "quote", "assign", "distinct_share",
    "colons", "gap", "prefix", "assign_at_end",
    *(f"cue_{k}" for k in KINDS),
)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed formats: by kind, leftmost first, none overlapping another of its kind.

    The scans walk along runs, so no text makes them take more than linear time.
    """
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", begin, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    if not _DIGIT.search(text):
        return out
    for m in _DOTTED.finditer(text):
        if (parts := m.group().split("."))[3:]:
            begin = m.start()
            for i in range(0, len(parts) - 3, 4):
                end = begin + sum(map(len, parts[i : i + 4])) + 3
                if all(map(_octet, parts[i : i + 4])):
                    out.append(("ip", begin, end))
                begin = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_DIGIT.findall(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> Iterator[Span]:
    """Loose spans of every kind; they may overlap each other and the fixed ones."""
    if not _ANY.search(text):
        return
    for kind in KINDS:
        for pattern in _LOOSE[kind]:
            for m in pattern.finditer(text):
                # a secret is a whole run, or value, of whatever length that has a digit somewhere
                span = m.span(pattern.groups if kind == "secret" else 0)
                if kind != "secret" or _DIGIT.search(text, *span):
                    yield kind, *span


def describe(text: str, start: int, end: int) -> list[float]:
    """Format and context of a span, in the order of FEATURES."""
    s, before = text[start:end], text[max(0, start - CONTEXT) : start]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    counts = Counter(s)
    n = len(s)
    near = before[-4:]
    last = before.lower()
    tail = re.search(r"[A-Za-z]*$", s).group()
    octets = s.split(".")
    return [
        n, len(digits), sum(c.isalpha() for c in s), sum(c.isupper() for c in s), sum(c in " ().-/" for c in s), len(groups),
        max(map(len, groups), default=0), min(map(len, groups), default=0), s[0] == "+", "(" in s or "[" in s, "@" in s, s.count("."),
        len(tail), bool(digits) and _luhn(digits), len(octets) == 4 and all(p.isdigit() and _octet(p) for p in octets),
        -sum(c / n * math.log2(c / n) for c in counts.values()), sum(c in "0123456789abcdefABCDEF" for c in s) / n,
        before[-1:].isalnum(), text[end : end + 1].isalnum(), bool(re.search(r"[\"'`]", near)), bool(re.search(r"[=:]", near)), len(counts) / n,
        s.count(":"), "::" in s, bool(_PREFIX.match(s)), before.rstrip(" \"'`")[-1:] in ("=", ":"),
        *(any(c in last for c in _CUES[k]) for k in KINDS),
    ]


def _weak_label(kind: str, x: list[float], start: int, end: int, base: list[Span]) -> int | None:
    """1 where a fixed format vouches for a candidate, for secrets a known prefix, or a random run right after
    a telling name; 0 where neither format nor context speaks for it; none between the two, and where a
    candidate holds a span of a fixed format among more."""
    told = dict(zip(FEATURES, x))
    if kind == "secret":
        random = told["entropy"] > 3
        if told["prefix"] or (told["cue_secret"] and told["assign_at_end"] and random):
            return 1
        return None if random and (told["cue_secret"] or told["assign"]) else 0
    if any(k == kind and a <= start + 1 and end - 1 <= b for k, a, b in base):
        return 1
    formed = {"email": told["at"] and told["dots"], "ip": told["octets"] or told["gap"] or told["colons"] == 7, "card": told["luhn"], "phone": 7 <= told["digits"] <= 15}
    if any(k == kind and a < end and start < b for k, a, b in base) or (formed[kind] and told[f"cue_{kind}"]):
        return None
    return 0


def seeds(n: int = 150, seed: int = 5) -> list[tuple[str, list[float], int]]:
    """Written examples of looser forms, and of numbers and words that are none: (kind, features, label)."""
    rng = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghinorstu"), rng.integers(3, 9)))
    hexa = lambda k: "".join(rng.choice(list("0123456789abcdef"), k))
    base64 = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")

    def mixed(k):
        """k letters and digits, a digit at least; half of them hold few digits."""
        made = rng.choice(base64[: 52 if rng.random() < 0.5 else 62], k)
        made[rng.integers(0, k)] = num(1)
        return "".join(made)

    def card(k):
        """k digits that pass the checksum."""
        lead = num(k - 1)
        return next(lead + c for c in "0123456789" if _luhn(lead + c))

    def secret():
        """A run of a usual kind: hex digits, letters and digits, or with signs of base 64 between."""
        k = int(rng.integers(20, 65))
        signs = "".join(str(rng.choice(["/", "+"])) if i and rng.random() < 0.05 else c for i, c in enumerate(mixed(k))) + num(1) + "=" * int(rng.integers(0, 3))
        return str(rng.choice([hexa(k - 1) + num(1), mixed(k), signs]))

    made = []
    for _ in range(n):
        name, host = f"{word()}.{word()}", word()
        made += [
            ("email", f"{rng.choice(['mail', 'contact', 'write to'])}: ", f"{name} [at] {host} [dot] com", 1),
            ("email", f"{word()} ", f"{name} (at) {host}.org", 1),
            ("email", f"{word()} ", f"{word()}@{word()}", 0),
            ("ip", f"{rng.choice(['host', 'server', 'ip addr'])} ", ":".join(hexa(4) for _ in range(8)), 1),
            ("ip", f"{rng.choice(['host', 'server', 'ip addr'])} ", f"{rng.choice(['fe80', 'fd00', '2001:db8'])}::{hexa(int(rng.integers(1, 5)))}", 1),
            ("ip", f"{word()} ", f"{num(2)}:{num(2)}:{num(2)}", 0),
            ("ip", f"{rng.choice(['host', 'server'])} ", f"{num(2)}:{num(2)}:{num(2)}", 0),
            ("ip", "version ", f"{num(3)}.{num(4)}.{num(4)}.{num(5)}", 0),
            ("ip", f"{word()} ", ":".join(num(2) for _ in range(4)), 0),
            ("phone", f"{rng.choice(['tel', 'phone', 'call', 'fax'])}{rng.choice([': ', ' ', '. '])}", f"0{num(3)} {num(3)} {num(4)}", 1),
            ("phone", f"{rng.choice(['Tel.', 'mobile:'])} ", f"({num(3)}) {num(3)}-{num(4)}", 1),
            ("phone", f"{word()} ", f"{num(4)}-{num(2)}-{num(2)}", 0),
            ("phone", f"{word()} {word()} ", num(int(rng.integers(7, 16))), 0),
            ("phone", f"{word()} ", f"{num(2)} {num(3)} {num(3)}", 0),
            ("card", f"{rng.choice(['card', 'visa', 'credit card', 'payment'])}{rng.choice([' ', ': ', ' no. '])}", card(int(rng.integers(13, 16))), 1),
            ("card", f"{rng.choice(['card', 'Card', 'amex card'])} ", "{0} {1} {2}".format((c := card(15))[:4], c[4:10], c[10:]), 1),
            ("card", f"{word()} ", num(int(rng.integers(12, 16))), 0),
            ("card", f"{word()} ", card(int(rng.integers(13, 16))), 0),
            ("card", f"{rng.choice(['card', 'visa', 'payment'])} ", (c := card(14))[:-1] + str((int(c[-1]) + 1) % 10), 0),
            ("card", f"order {word()} ", f"{num(4)} {num(4)} {num(4)}", 0),
            ("secret", f"{rng.choice(['token', 'api_key', 'secret', 'password'])}{rng.choice([' = ', ': ', '='])}\"", secret(), 1),
            ("secret", f"{rng.choice(['API_KEY', 'ACCESS_TOKEN', 'export AUTH_TOKEN', 'SECRET_ACCESS_KEY', 'credential'])}{rng.choice(['=', ' = ', ': '])}", secret(), 1),
            ("secret", f"{rng.choice(['Bearer', 'Authorization: Bearer', 'auth bearer', 'token'])} ", secret(), 1),
            ("secret", f"{word()} ", f"AKIA{mixed(16).upper()}", 1),
            ("secret", f"{rng.choice([word(), 'Bearer', 'token:'])} ", f"{rng.choice(['ghp_', 'sk-', 'gho_'])}{mixed(36)}", 1),
            ("secret", f"{rng.choice(['password', 'Password', 'pwd', 'passphrase', 'secret'])}{rng.choice([': ', '=', ' = '])}", f"{word()}{num(int(rng.integers(1, 5)))}", 1),
            ("secret", f"{word()} ", hexa(40), 0),
            ("secret", f"{rng.choice(['commit', 'sha256', 'digest', 'id'])}{rng.choice([' ', ': '])}", hexa(int(rng.choice([32, 40, 64]))), 0),
            ("secret", f"{rng.choice([word(), 'id:', 'uuid ='])} ", "-".join(hexa(k) for k in (8, 4, 4, 4, 12)), 0),
            ("secret", f"{word()} key {word()} {word()} ", f"{word()}-{word()}-{word()}-{num(2)}", 0),
            ("secret", f"{word()} ", f"{word()}-{word()}-{word()}-{num(4)}", 0),
            ("secret", f"{word()} ", num(int(rng.integers(16, 30))), 0),
            ("secret", f"{word()} see ", f"{word()}/{word()}/{word()}{num(2)}/{word()}", 0),
        ]
    out = []
    for kind, lead, body, label in made:
        text = f"{word()} {lead}{body} {word()}" if not lead.endswith('"') else f"{word()} {lead}{body}\" {word()}"
        start = text.index(lead) + len(lead)
        out.append((kind, describe(text, start, start + len(body)), label))
    return out


@dataclass
class Finder:
    """Trees and threshold for each kind."""

    trees: dict[str, boosting.Trees]
    thresholds: dict[str, float]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Selected candidates that touch no fixed span; of overlapping ones the best, then the first, then the longest.

        A secret goes on over the long runs joined to it by dots, the payload and signature of a signed token.
        """
        proposed = [c for c in dict.fromkeys(candidates(text)) if all(c[2] <= a or b <= c[1] for _, a, b in base)]
        if not proposed:
            return []
        x = np.array([describe(text, a, b) for _, a, b in proposed], float)
        score = np.zeros(len(proposed))
        kinds = np.array([k for k, _, _ in proposed])
        for kind in set(kinds.tolist()):
            rows = kinds == kind
            p = self.trees[kind].probability(x[rows])
            score[rows] = np.where(p >= self.thresholds[kind], p, 0)
        taken: list[Span] = []
        for i in sorted(np.flatnonzero(score), key=lambda i: (-score[i], proposed[i][1], -proposed[i][2])):
            kind, a, b = proposed[i]
            if all(b <= c or d <= a for _, c, d in taken):
                if kind == "secret" and (m := _JOINED.match(text, b)):
                    b = min([m.end(), *(c for _, c, _ in taken if c >= b)])
                taken.append((kind, a, b))
        return taken

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Fixed spans, and all spans, each by kind and start."""
        order = lambda s: (KINDS.index(s[0]), s[1], s[2])
        base = base_spans(text)
        return sorted(base, key=order), sorted(base + self.added(text, base), key=order)


def _threshold(p: np.ndarray, y: np.ndarray) -> float | None:
    """The lowest score from 0.8 on above which the held-out candidates are right as often as PRECISION asks."""
    for t in np.arange(0.8, 1.0, 0.02):
        chosen = p >= t
        if chosen.any() and y[chosen].mean() >= PRECISION:
            return float(t)
    return None


def fit_finder(rows: list[tuple[str, list[float], int]], seeded: list[tuple[str, list[float], int]] = ()) -> Finder:
    """Trees on three quarters of each kind's rows, and a threshold on the rest.

    The seeded examples weigh as much as the corpus' rows where these are more: they are repeated, within
    their side of the split. A kind that reaches the precision at no threshold adds nothing, which is logged.
    """
    trees, thresholds = {}, {}
    for kind in KINDS:
        parts = []
        own, made = [r for r in rows if r[0] == kind], [r for r in seeded if r[0] == kind]
        for part, times in ((own, 1), (made, max(1, round(len(own) / max(1, len(made)))))):
            x, y = np.array([r[1] for r in part], float).reshape(-1, len(FEATURES)), np.array([r[2] for r in part], float)
            apart = np.arange(len(y)) % 4 == 3
            parts.append((np.repeat(x[~apart], times, 0), np.repeat(y[~apart], times), x[apart], y[apart]))
        x, y, x_apart, y_apart = (np.concatenate(c) for c in zip(*parts))
        trees[kind] = boosting.fit(x, y, trees=40, depth=5)
        found = _threshold(trees[kind].probability(x_apart), y_apart)
        if found is None:
            logging.getLogger(__name__).warning("no threshold gives %s a precision of %s: only fixed formats are found", kind, PRECISION)
        thresholds[kind] = math.inf if found is None else found
    return Finder(trees, thresholds)


def train(documents: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 9) -> Finder:
    """A finder from the candidates of at most TRAIN_DOCUMENTS documents, chosen by a seeded hash."""
    chosen = F.broadcast(seeded_sample(documents.select(id), TRAIN_DOCUMENTS, seed, id))
    sample = documents.select(id, text).join(chosen, id).where(F.col(text).rlike("[0-9@]")).select(text)

    def run(batches):
        for batch in batches:
            rows = []
            for said in batch.column(0).to_pylist():
                base = base_spans(said)
                for kind, a, b in dict.fromkeys(candidates(said)):
                    x = describe(said, a, b)
                    label = _weak_label(kind, x, a, b, base)
                    if label is not None:
                        rows.append((kind, x, label))
            if rows:
                kinds, xs, ys = zip(*rows)
                yield pa.record_batch([pa.array(kinds), pa.array([[float(v) for v in x] for x in xs]), pa.array(ys, pa.int32())], ["kind", "x", "y"])

    found = sample.mapInArrow(run, "kind string, x array<double>, y int")
    found = found.orderBy(F.xxhash64("kind", "x", "y"), "kind", "x", "y").limit(TRAIN_CANDIDATES).collect()
    rng = np.random.default_rng(seed)
    rows, made = [(r["kind"], list(r["x"]), r["y"]) for r in found], seeds()
    return fit_finder([rows[i] for i in rng.permutation(len(rows))], [made[i] for i in rng.permutation(len(made))])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(documents: DataFrame, finder: Finder, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row for each row in.

    The counts and the hash are of the fixed spans, ``spans`` lists all. A null text is empty and has no
    spans; repeated rows are told alike; a null id stays null; other columns are ignored.
    """
    kind = documents.schema[id].dataType.simpleString()
    names = [id, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]

    def run(batches):
        for batch in batches:
            rows = []
            for said in batch.column(1).to_pylist():
                base, every = finder.spans(said or "")
                n = Counter(k for k, _, _ in base)
                rows.append((*(n[k] for k in BASE_KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            if rows:
                yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) if i < 4 else pa.array(c) for i, c in enumerate(zip(*rows)))], names)

    return documents.select(id, text).mapInArrow(
        run, f"{id} {kind}, {', '.join(f'n_{k} long' for k in BASE_KINDS)}, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or each chain of overlapping spans, replaced by the kind of its first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, finder: Finder, text: str = "text") -> DataFrame:
    """``documents`` with redacted texts, all columns and rows kept; a null text stays null."""

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text)
            said = [t if t is None else redacted(t, finder.spans(t)[1]) for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(said, batch.schema.field(i).type))

    return documents.mapInArrow(run, documents.schema)
