"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns and are always reported. The method adds
``iban`` (confirmed by mod-97) and ``card15`` (15 digits that pass Luhn, reported only where a word such
as "card" stands nearby). Offsets are code points, ends exclusive. Each span has a score: what its
pattern and check are worth, raised by context words within ``CONTEXT`` characters.

Defined results: null and empty texts have no spans; rows are independent, so repeated rows repeat.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.llm.common import slices

#: Code points before and after a span in which context words count.
CONTEXT = 40
#: An added span is reported from this score on.
ENOUGH = 0.7


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters go to the end, letters count from 10, the rest is 1."""
    code = re.sub(r"\s", "", iban)
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: re.Pattern
    valid: object
    base: float
    context: re.Pattern
    added: bool = False
    needs: str = ""  # a text without this character has no such span


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


# The local part of an address is found from its "@": a run of its characters ends there or nowhere.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

KINDS = [
    Kind("email", _DOMAIN, None, 0.9, re.compile(r"mail|contact|write", re.I), needs="@"),
    # No match can begin within a run of digits, so runs are entered at their first digit only.
    Kind("ip", re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), lambda s: all(len(d := p.lstrip("0")) < 4 and int(d or "0") <= 255 for p in s.split(".")),
         0.7, re.compile(r"\bip\b|address|host|server", re.I), needs="."),
    Kind("card", re.compile(r"[0-9](?:[\x20-]?[0-9])+"), lambda s: 16 <= len(d := _digits(s)) <= 19 and luhn(d),
         0.8, re.compile(r"card|visa|master|credit|karte|tarjeta|carte", re.I)),
    Kind("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 8 <= len(_digits(s)) <= 15,
         0.7, re.compile(r"phone|call|tel|mobile|fax", re.I), needs="+"),
    Kind("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
         lambda s: 15 <= len(s.replace(" ", "")) <= 34 and mod97(s), 0.8, re.compile(r"iban|account|bank|konto|cuenta|compte", re.I), added=True),
    Kind("card15", re.compile(r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){14}(?![\x20-]?[0-9])"), lambda s: luhn(_digits(s)),
         0.5, re.compile(r"card|amex|credit|karte|tarjeta|carte", re.I), added=True),
]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in re.finditer("@", text):
        if m.start() < done:
            continue
        a = m.start()
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start() and (d := _DOMAIN.match(text, m.start())):
            done = d.end()
            yield a, done


def spans(text: str | None) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) of all spans, by kind as listed and then by start."""
    out = []
    for kind in KINDS if text else ():
        if kind.needs and kind.needs not in text:
            continue
        found = _emails(text) if kind.name == "email" else (m.span() for m in kind.pattern.finditer(text))
        for a, b in found:
            if kind.valid is not None and not kind.valid(text[a:b]):
                continue
            near = text[max(0, a - CONTEXT):a] + " " + text[b:b + CONTEXT]
            score = min(1.0, kind.base + 0.2 * bool(kind.context.search(near)))
            if not kind.added or score >= ENOUGH:
                out.append((kind.name, a, b, round(score, 2), not kind.added))
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with counts, base digest, all spans and their scores."""
    names = ["email", "ip", "card", "phone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [spans(t) for t in b.column("text").to_pylist()]
            base = [",".join(f"{k}:{a}:{e}" for k, a, e, _, own in r if own) for r in rows]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), *(pa.array([sum(own and k == n for k, _, _, _, own in r) for r in rows], pa.int64()) for n in names),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
                pa.array([",".join(f"{k}:{a}:{e}" for k, a, e, _, _ in r) for r in rows], pa.string()),
                pa.array([",".join(str(s) for *_, s, _ in r) for r in rows], pa.string()),
            ], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns; every span of a text becomes its kind in angle brackets."""

    def clean(text: str | None) -> str | None:
        for kind, a, b, *_ in sorted(_apart(spans(text)), key=lambda s: -s[1]):
            text = f"{text[:a]}<{kind}>{text[b:]}"
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = b.schema.get_field_index("text")
            field = b.schema.field(at)
            yield b.set_column(at, field, pa.array([clean(t) for t in b.column("text").to_pylist()], field.type))

    return docs.mapInArrow(run, docs.schema)


def _apart(found: list) -> list:
    """Spans without those that overlap a longer one."""
    out: list = []
    for s in sorted(found, key=lambda s: (s[1] - s[2], s[1])):
        if all(s[2] <= o[1] or s[1] >= o[2] for o in out):
            out.append(s)
    return out
