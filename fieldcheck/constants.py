"""Fixed values of the record format: column names, maps, rules, labels and patterns."""

from __future__ import annotations

# Zone in which upload names and visit times are written.
SOURCE_ZONE = "Asia/Makassar"

# --- columns of an upload -----------------------------------------------------
BASE_COLUMNS = ["puskesmas_name", "puskesmas_id", "tanggal", "file_name"]
CLINICAL_COLUMNS = [
    "berat_badan", "tinggi", "lingkar_perut", "sistole", "diastole",
    "detak_nadi", "nafas", "suhu",
]
PII_COLUMNS = [
    "nik", "no_telp", "nama_pasien", "alamat", "tgllahir",
    "dokter_tenaga_medis", "perawat_bidan_nutrisionist_sanitarian",
]
OTHER_COLUMNS = ["diagnosa_1", "umur_tahun"]
WANTED_COLUMNS = BASE_COLUMNS + CLINICAL_COLUMNS + PII_COLUMNS + OTHER_COLUMNS
LIVE_COLUMNS = WANTED_COLUMNS + ["posyandu"]

# --- columns that may be stored after anonymizing -------------------------------
SAFE_REQUIRED = [
    "nik_masked", "phone_masked", "nik_hash", "phone_hash",
    "nik_len", "nik_len_ok", "phone_len", "phone_len_ok",
    "name_present", "dokter_pseudo", "doctor_present",
    "staff_pseudo", "staff_present",
]
SAFE_COLUMNS = [
    *BASE_COLUMNS, *CLINICAL_COLUMNS, *OTHER_COLUMNS,
    "day", "PKM", "PKM_norm", "file_ts", "tanggal_ts",
    *SAFE_REQUIRED,
]

# --- friendly names -----------------------------------------------------------------
CLINICAL_MAP = {
    "Berat Badan": ["berat_badan"],
    "Tinggi": ["tinggi"],
    "Lingkar Perut": ["lingkar_perut"],
    "Sistole": ["sistole"],
    "Diastole": ["diastole"],
    "Detak Nadi": ["detak_nadi"],
    "Nafas": ["nafas"],
    "Suhu": ["suhu"],
}
ADMIN_MAP = {
    "NIK": ["nik_masked", "nik_hash", "nik_len"],
    "Nama Pasien": ["name_present"],
    "No Telp": ["phone_masked", "phone_hash", "phone_len"],
    "Dokter / Tenaga Medis": ["dokter_pseudo", "doctor_present"],
    "Perawat / Bidan / Nutrisionist / Sanitarian": ["staff_pseudo", "staff_present"],
    "Diagnosa 1": ["diagnosa_1"],
    "Umur Tahun": ["umur_tahun"],
    "Tgl.Lahir": [],
    "Alamat": [],
}
CLINICAL_VARS = list(CLINICAL_MAP)
NUMERIC_VARS = [*CLINICAL_VARS, "Umur Tahun"]
FACILITY_CANDIDATES = [
    "PKM", "puskesmas_name", "puskesmas", "nama_puskesmas", "faskes", "faskes_name",
]
DATE_CANDIDATES = [
    "tanggal", "date", "tgl", "day", "visit_date",
    "tanggal_pengukuran", "tanggal_kunjungan",
]
LOG_ID_CANDIDATES = [
    "Tanggal", "poliruangan", "ID_Kunjungan", "ID Kunjungan", "id_kunjungan",
    "No RM", "no_rm",
]

# --- range rules: variable, lowest and highest accepted value (both included) ---
DEFAULT_RULES = [
    ("Berat Badan", 1.0, 300.0),
    ("Tinggi", 30.0, 250.0),
    ("Sistole", 50.0, 260.0),
    ("Diastole", 30.0, 150.0),
    ("Detak Nadi", 20.0, 220.0),
    ("Nafas", 5.0, 80.0),
    ("Suhu", 30.0, 43.0),
    ("Lingkar Perut", 10.0, 200.0),
]

# --- thresholds -----------------------------------------------------------------------
PREFERRED_SHARE = 0.15
INTEGER_TOLERANCE = 1e-8
HEAPING_EXCLUDED = ["Nafas", "Suhu"]
ID_LENGTH = 16
PHONE_LENGTH = (10, 12)
ID_TAIL = 4
PHONE_TAIL = 3
BIN_PADDING = 0.03
OLDEST_DATE = "1900-01-01"

# --- labels -------------------------------------------------------------------------------
RULE_LABELS = {
    "nik": "Invalid length (≠16)",
    "phone": "Invalid length (10–12)",
    "date": "Invalid date",
    "numeric": "Non-numeric / out-of-range",
    "text": "Invalid (non-missing)",
}
PRINT_LABELS = {
    "No.": "No.", "Variable": "Variabel", "Rows": "Baris",
    "Missing": "Kosong", "Missing %": "Kosong %",
    "Non_missing": "Terisi", "Non_missing %": "Terisi %",
    "Distinct (non-missing)": "Unik (terisi)",
    "Invalid (non-missing)": "Tidak valid (terisi)", "Rule": "Aturan validasi",
    "Min": "Min", "Q1": "Q1", "Median": "Median", "Q3": "Q3", "Max": "Max",
}
ACRONYMS = ["NIK", "BPJS", "ID", "UGD", "IGD", "KIA", "ANC", "MTBS", "BMI", "SPO2"]
STATUS_ORDER = ["Valid", "Invalid", "Missing"]

# --- patterns ---------------------------------------------------------------------------
FILE_TIME_PATTERN = r"\d{4}-\d{2}-\d{2} \d{2}_\d{2}_\d{2}\.\d{3}"
MASK_CHAR = "•"
ID_MASK_PATTERN = r"^•+\d{4}$"
PHONE_MASK_PATTERN = r"^•+\d{3}$"
FULL_MASK_PATTERN = r"^•+$"
HASH_PATTERN = r"^[0-9a-f]{64}$"
PSEUDONYM_PATTERN = r"^[DS]-[0-9a-f]{8}$"
DIGIT_RUN_PATTERN = r"\d{10,}"
BLANKS = " \t\r\n"
