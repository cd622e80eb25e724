"""Personal data: base patterns, plus candidates that boosted trees accept.

Base spans are found by the patterns alone and always stay. High-recall
generators propose further, overlapping spans in looser formats (obfuscated
addresses, numbers without a plus sign, dotted cards, ...). Boosted trees score
each by its format and context; those above their kind's calibrated threshold
are accepted, the best first, unless they overlap a span that is already there.
The trees learn from generated examples: every kind's valid forms, and look-alikes
that are none (order numbers, dates, versions, amounts, digit runs failing Luhn).
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.llm.boosting import BoostedTrees
from flowlark.llm.common import bounded_batches, trimmed

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# (a match can only start where a run of digits does, and takes runs whole: so each run is read once)
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """What the whole pattern finds, looked for from each @ outwards: a match starts where the run of local characters does."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            out.append((start, free))
        at = text.find("@", max(at + 1, free if m else 0))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end), sorted."""
    out = [(a, 0, z) for a, z in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# The generators: looser than the base patterns, and overlapping.
_RUN = re.compile(r"[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}")
_GAP = re.compile(r"[\x20/]+")
_OBFUSCATED = re.compile(r"[A-Za-z0-9._%+-]+(?:\x20?[\[({](?:at|@)[\])}]\x20?|\x20at\x20|\x20?@\x20?)[A-Za-z0-9-]+(?:(?:\x20?[\[({](?:dot|\.)[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]+)+", re.I)
_LOOSE_IP = re.compile(r"[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}")
_AT = re.compile(r"\x20?[\[({](?:at|@)[\])}]|\x20at\x20|\x20?@", re.I)
_LOCAL_LOOSE = re.compile(r"[A-Za-z0-9._%+-]", re.I)


def _obfuscated(text: str) -> list[tuple[int, int]]:
    """What the whole pattern finds, looked for from each separator outwards, as in _emails."""
    out, free, at = [], 0, _AT.search(text)
    while at:
        start = at.start()
        while start > free and _LOCAL_LOOSE.match(text, start - 1):
            start -= 1
        m = _OBFUSCATED.match(text, start) if start < at.start() else None
        if m:
            free = m.end()
            out.append((start, free))
        at = _AT.search(text, max(at.start() + 1, free if m else 0))
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) that may be personal data."""
    out: set[tuple[int, int, int]] = set()
    for m in _RUN.finditer(text):
        a, z = m.span()
        gaps = [(a + g.start(), a + g.end()) for g in _GAP.finditer(m.group())]
        starts, ends = [a, *(e for _, e in gaps)], [*(s for s, _ in gaps), z]
        digits = [len(_NOT_DIGIT.sub("", text[s:e])) for s, e in zip(starts, ends, strict=True)]
        # sub-spans between blanks; each group has a digit, so that at most 19 groups are looked at from each start
        for i, s in enumerate(starts):
            n = 0
            for e, d in zip(islice(ends, i, i + 19), islice(digits, i, i + 19), strict=True):
                n += d
                if n > 19:
                    break
                if 9 <= n <= 15:
                    out.add((s, 3, e))
                if n >= 13:
                    out.add((s, 2, e))
    if "[.]" in text or "." in text:
        for m in _LOOSE_IP.finditer(text):
            out.add((m.start(), 1, m.end()))
    out.update((a, 0, z) for a, z in _obfuscated(text))
    return sorted(out)


# Words that stand before personal data, in the corpus languages.
_CONTEXT = (
    re.compile(r"\b(?:e-?mail|mail|correo|courriel|contact|kontakt|write|schreib)\w*\W*$", re.I),
    re.compile(r"\b(?:ip|host|server|serveur|servidor|address|adresse|direcci[oó]n)\w*\W*$", re.I),
    re.compile(r"\b(?:card|karte|carte|tarjeta|visa|mastercard|credit|kredit)\w*\W*$", re.I),
    re.compile(r"\b(?:phone|tel|t[eé]l|call|fax|mobile|handy|telefon|tel[eé]fono|m[oó]vil|appel)\w*\W*$", re.I),
)
_NEGATIVE = re.compile(r"\b(?:order|invoice|version|v|isbn|id|no|nr|ref|date|price|total|commande|bestellung|pedido|number|sku|build)\W*$", re.I)


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 2]
    digits = _NOT_DIGIT.sub("", s)
    groups = re.findall(r"[0-9]+", s)
    near = before[-1:]
    return [
        float(kind), float(len(s)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(s.startswith("+")), float("(" in s and ")" in s), float(s.count("-")), float(s.count(".")), float(s.count(" ")), float(s.count("/")),
        float(bool(digits) and luhn(digits)), float(digits[:2] == "00"), float(digits[:1] in ("3", "4", "5", "6")), float(len({len(g) for g in groups}) == 1),
        float(all(int(g[:6]) <= 255 for g in groups) if groups else 0), float(s.count("(") == s.count(")")),
        float(near.isalnum() or near in ("_", "=", "-", ".", "/", "#", "$", "€")), float(after[:1].isalnum() or after[:1] in ("_", "%", "€") or (after[:1] in ("-", ".", "/") and after[1:2].isalnum())),
        float(bool(_CONTEXT[kind].search(before))), float(bool(_NEGATIVE.search(before))), float(any(c.search(before) for i, c in enumerate(_CONTEXT) if i != kind)),
        float("@" in s), float(bool(re.search(r"[\[({](?:at|@|dot|\.)", s, re.I))), float(bool(re.search(r" at .* dot ", s, re.I))), float(s[-4:].lower() in (".com", ".org", ".net", " com", " org", " net")), float(len(set(digits))),
    ]


def _examples(n: int, seed: int = 7) -> list[tuple[str, int, int]]:
    """(text, kind asked about, whether the span between the marks \\x02 and \\x03 is of it)."""
    r = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, r.integers(0, 10, k)))
    pick = lambda a: a[int(r.integers(len(a)))]
    word = lambda: "".join(pick("abcdefghijklmnoprstuvw") for _ in range(int(r.integers(2, 9))))

    def card(ok: bool) -> str:
        body = pick("3456") + d(14)
        check = next(c for c in "0123456789" if luhn(body + c))
        body += check if ok else str((int(check) + int(r.integers(1, 10))) % 10)
        sep = pick(["", " ", "-", ".", "/"])
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = str(r.integers(2, 10)) + d(2), str(r.integers(2, 10)) + d(2), d(4)
        return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"001 {a} {b} {c}", f"{a} {b} {c}", f"+1 ({a}) {b}-{c}", f"0049 {a} {d(7)}", f"+{d(2)} {a} {b} {c}"])

    def address(loose: bool) -> str:
        at, dot = pick([(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", ".")]) if loose else ("@", ".")
        return f"{word()}{pick(['', '.', '_'])}{pick(['', d(2)])}{at}{word()}{dot}{pick(['com', 'org', 'net', 'example' + dot + 'com'])}"

    hint = ("email ", "ip ", "card ", "phone ")
    bad = ("order ", "invoice no ", "version ", "ref ", "total ", "")
    out = []
    for _ in range(n):
        kind, good = int(r.integers(4)), bool(r.integers(2))
        lead = f"{word()} {word()} "
        if good:
            body = [lambda: address(True), lambda: ".".join(str(r.integers(0, 256)) for _ in range(4)).replace(".", pick([".", "[.]"])), lambda: card(True), phone][kind]()
            lead += pick([hint[kind], "", ""])
            tail = pick([" ", ". ", ", "]) + word()
        else:
            body = [
                lambda: f"{word()} at {word()}.{word()}",
                lambda: pick([f"{d(1)}.{d(1)}.{d(2)}.{r.integers(256, 1000)}", f"{r.integers(300, 999)}.{d(3)}.{d(2)}.{d(1)}"]),
                lambda: card(False),
                lambda: pick([d(10), d(12), f"{r.integers(1900, 2030)}-{d(2)}-{d(2)} {d(2)}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(4)} {d(4)} {d(4)}", f"{d(4)}/{d(3)}/{d(4)}"]),
            ][kind]()
            lead += pick(bad)
            tail = pick([" ", ". ", ", ", "%", "-x", "9"]) + word()
        if good and r.random() < 0.1:  # the same form glued to other characters is none
            lead, good = lead + pick(["=", "#", "x", "_"]), False
        out.append((f"{lead}\x02{body}\x03{tail}", kind, int(good)))
    return out


@lru_cache(maxsize=1)
def model() -> tuple[BoostedTrees, tuple[float, ...]]:
    """The trees and each kind's threshold: the least at which 99 % of accepted held-out examples are right, 0.7 at least."""
    xs, ys = [], []
    for text, kind, y in _examples(6000):
        a, z = text.index("\x02"), text.index("\x03") - 1
        xs.append(features(text.replace("\x02", "").replace("\x03", ""), a, kind, z))
        ys.append(y)
    x, y = np.array(xs), np.array(ys, dtype=float)
    trees = BoostedTrees().fit(x[:4000], y[:4000])
    p = trees.predict(x[4000:])
    limits = []
    for kind in range(4):
        own = x[4000:, 0] == kind
        order = np.argsort(-p[own])
        right = np.cumsum(y[4000:][own][order]) / np.arange(1, own.sum() + 1)
        ok = np.flatnonzero(right >= 0.99)
        limits.append(max(0.7, float(p[own][order][ok[-1]]) if len(ok) else 1.1))
    return trees, tuple(limits)


#: Candidates that are scored at once.
CHUNK = 4096


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], trees: BoostedTrees, limits) -> list[list[tuple[int, int, int]]]:
    """Accepted candidates of each text, none overlapping a base span or another accepted one."""
    taken = [bytearray(len(t)) for t in texts]
    for t, spans in zip(taken, base, strict=True):
        for s, _, e in spans:
            t[s:e] = b"\1" * (e - s)
    good: list[tuple[float, int, tuple[int, int, int]]] = []
    free = ((i, c) for i, t in enumerate(texts) for c in candidates(t) if 1 not in taken[i][c[0] : c[2]])
    while some := list(islice(free, CHUNK)):
        p = trees.predict(np.array([features(texts[i], *c) for i, c in some]))
        good += [(-v, i, c) for v, (i, c) in zip(p.tolist(), some, strict=True) if v >= limits[c[1]]]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for _, i, (s, kind, e) in sorted(good):
        if 1 not in taken[i][s:e]:
            taken[i][s:e] = b"\1" * (e - s)
            out[i].append((s, kind, e))
    return [sorted(o) for o in out]


SCHEMA = "doc_id long, base array<struct<start:int,kind:string,end:int>>, added array<struct<start:int,kind:string,end:int>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans (start, kind, end in code points, end exclusive), by start and then kind.

    Whole texts are searched. A null text has no spans; repeated rows each give
    a row; a null doc_id stays null; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    fitted = spark.sparkContext.broadcast(model())  # 60 trees of depth 3
    struct = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
    show = lambda rows: pa.array([[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in r] for r in rows], struct)

    @trimmed
    def run(batches):
        trees, limits = fitted.value
        for b in batches:
            texts = b.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), show(base), show(added_spans(texts, base, trees, limits))], names=["doc_id", "base", "added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def redact(text: str, spans) -> str:
    """text with each (start, kind, end) replaced by its kind in brackets; of overlapping spans the first stands."""
    out, at = [], 0
    for s, kind, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
    return "".join([*out, text[at:]])


def digest(found: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, SHA-256 of the base spans as text, and all spans as text."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    keyed = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    every = F.array_sort(keyed(F.concat("base", "added")))
    n = lambda k: F.array_size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(n, KINDS), F.sha2(line("base").cast("binary"), 256).alias("base_sha256"), line(every).alias("spans"), F.array_size("added").cast("long").alias("n_added"))
