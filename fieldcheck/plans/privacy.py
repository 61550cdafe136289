"""Anonymizing of identifiers and the audit of anonymized tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from fieldcheck.constants import (
    FULL_MASK_PATTERN, HASH_PATTERN, ID_MASK_PATTERN, ID_TAIL, PHONE_MASK_PATTERN, PHONE_TAIL,
    PII_COLUMNS, PSEUDONYM_PATTERN, SAFE_REQUIRED,
)
from fieldcheck.functions.text import (
    digits_only, has_digit_run, id_length_ok, is_present, mask_tail, matches_or_null,
    norm_name, normalize_person, normalize_phone, phone_length_ok, pseudonym, salted_hash,
)
from fieldcheck.operators.filters import any_present
from fieldcheck.operators.ranking import preview
from fieldcheck.operators.schema import ensure_columns, project_safe, quoted


@dataclass(frozen=True)
class Salts:
    """One secret per kind of identifier. There is no default: the caller must bring them."""

    nik: str
    phone: str
    doctor: str
    staff: str

    def __post_init__(self):
        if not all((self.nik, self.phone, self.doctor, self.staff)):
            raise ValueError("every salt must be set")


#: Cleaned identifiers, which never leave ``anonymize``.
HELPERS = ("_nik", "_phone", "_doctor", "_staff")


def _filled(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def cleaned_identifiers(map_country_code: bool = False) -> dict[str, Column]:
    """Digits of identifiers and one spelling per name, NULL when nothing is left."""
    phone = normalize_phone("no_telp") if map_country_code else digits_only("no_telp")
    return {
        "_nik": _filled(digits_only("nik")),
        "_phone": _filled(phone),
        "_doctor": _filled(normalize_person("dokter_tenaga_medis")),
        "_staff": _filled(normalize_person("perawat_bidan_nutrisionist_sanitarian")),
    }


def safe_identifiers(salts: Salts) -> dict[str, Column]:
    """The safe columns by name, from the cleaned identifiers."""
    return {
        "nik_len": F.length("_nik"), "nik_len_ok": id_length_ok(F.length("_nik")),
        "phone_len": F.length("_phone"), "phone_len_ok": phone_length_ok(F.length("_phone")),
        "nik_masked": mask_tail("_nik", ID_TAIL), "phone_masked": mask_tail("_phone", PHONE_TAIL),
        "nik_hash": salted_hash("_nik", salts.nik),
        "phone_hash": salted_hash("_phone", salts.phone),
        "name_present": is_present("nama_pasien"),
        "dokter_pseudo": pseudonym(salted_hash("_doctor", salts.doctor), "D"),
        "doctor_present": F.col("_doctor").isNotNull(),
        "staff_pseudo": pseudonym(salted_hash("_staff", salts.staff), "S"),
        "staff_present": F.col("_staff").isNotNull(),
    }


def anonymize(
    df: DataFrame, salts: Salts, map_country_code: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """Lengths, flags, hashes, masks and pseudonyms instead of raw identifiers.

    Two projections, no shuffle: identifiers are cleaned once and then used several times.
    ``keep`` names further columns without personal data to carry along.
    """
    cleaned = ensure_columns(df).withColumns(cleaned_identifiers(map_country_code))
    return project_safe(cleaned.withColumns(safe_identifiers(salts)), keep, HELPERS)


FORMATS = {
    "nik_masked": [ID_MASK_PATTERN, FULL_MASK_PATTERN],
    "phone_masked": [PHONE_MASK_PATTERN, FULL_MASK_PATTERN],
    "nik_hash": [HASH_PATTERN],
    "phone_hash": [HASH_PATTERN],
    "dokter_pseudo": [PSEUDONYM_PATTERN],
    "staff_pseudo": [PSEUDONYM_PATTERN],
}


#: Masked column whose printed name is a spelling of the raw column.
FRIENDLY_MASKS = {"nik": "nik_masked", "no_telp": "phone_masked"}


def format_ok(column: str, name: str | None = None) -> Column:
    """The text of ``name`` (else of the column) has one of the column's allowed forms; NULL passes."""
    ok = F.lit(False)
    for pattern in FORMATS[column]:
        ok = ok | matches_or_null(quoted(name or column).cast("string"), pattern)
    return ok


def pii_audit(
    df: DataFrame, forbidden: Sequence[str] = PII_COLUMNS,
    required: Sequence[str] = SAFE_REQUIRED,
) -> DataFrame:
    """``check, column, violations, ok``: forbidden and required columns, formats, digit runs.

    Column presence is known from the schema; all row checks are one aggregate. Forbidden names
    are met in any spelling (``Nama Pasien``, ``nama_pasien``); a friendly name of a masked column,
    such as ``NIK``, is allowed as far as its values are masked. Hash columns are left out of the
    digit-run check as far as their values are well-formed hashes.
    """
    rows, aggs = audit_checks(df, forbidden, required)
    table = F.array(*[
        F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"),
                 F.coalesce(F.col(agg), F.lit(0)).alias("violations"))
        for check, column, agg in rows
    ])
    return df.agg(*aggs).select(F.inline(table)).withColumn("ok", F.col("violations") == 0)


def audit_checks(
    df: DataFrame, forbidden: Sequence[str] = PII_COLUMNS, required: Sequence[str] = SAFE_REQUIRED,
) -> tuple[list[tuple[str, str, str]], list[Column]]:
    """The checks of ``pii_audit`` as (check, column, name of its aggregate), and the aggregates."""
    rows, aggs = [], []

    def add(check: str, column: str, violations: Column) -> None:
        rows.append((check, column, f"_{len(rows)}"))
        aggs.append(violations.cast("bigint").alias(rows[-1][2]))

    for c in forbidden:
        met = [d for d in df.columns if norm_name(d) == norm_name(c)]
        masked = FRIENDLY_MASKS.get(c)
        if masked and met and c not in [d.lower() for d in met if d == d.lower()]:
            add("forbidden_absent", c, sum((F.count_if(~format_ok(masked, d)) for d in met), F.lit(0)))
        else:
            add("forbidden_absent", c, F.max(F.lit(len(met))))
    for c in required:
        add("required_present", c, F.max(F.lit(0 if c in df.columns else 1)))
    for c in FORMATS:
        if c in df.columns:
            add("format", c, F.count_if(~format_ok(c)))
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            c = quoted(field.name)
            leak = F.coalesce(has_digit_run(c), F.lit(False))
            if FORMATS.get(field.name) == [HASH_PATTERN]:
                leak = leak & ~c.rlike(HASH_PATTERN)
            add("digit_run", field.name, F.count_if(leak))
    return rows, aggs


class Leak(Exception):
    """What was about to be published failed the audit; ``violations`` lists (check, column, rows)."""

    def __init__(self, violations: list[tuple[str, str, int]]):
        super().__init__(", ".join(f"{check} {column}: {n}" for check, column, n in violations))
        self.violations = violations


class Audited:
    """A table whose audit is counted while it is written, without a scan of its own.

    Write ``self.df``, then ask ``violations``. A retried stage may count a row twice, which
    never turns a violation into none.
    """

    def __init__(self, df: DataFrame, forbidden: Sequence[str] = PII_COLUMNS, required: Sequence[str] = SAFE_REQUIRED):
        self._rows, aggs = audit_checks(df, forbidden, required)
        self._seen = Observation()
        self.df = df.observe(self._seen, *aggs)

    def counts(self) -> list[tuple[str, str, int]]:
        found = self._seen.get
        return [(check, column, found[name] or 0) for check, column, name in self._rows]

    def require_clean(self) -> None:
        """Raises ``Leak`` if any check counted a row."""
        bad = [x for x in self.counts() if x[2]]
        if bad:
            raise Leak(bad)


def audit_preview(df: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """First rows with at least one identifier, identifiers only."""
    shown = ["nik_masked", "phone_masked", "dokter_pseudo", "staff_pseudo"]
    rows = any_present(df, shown)
    hashes = ["nik_hash", "phone_hash"]
    return preview(rows, n, keys).select(*shown[:2], *hashes, *shown[2:])
