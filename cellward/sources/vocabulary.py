"""The identifier vocabulary: which column names are out of reach, and why.

A vocabulary is a small set of names on the driver. It enters plans either as a hash-set
literal (``Column.isin``, one lookup per token, no shuffle) or as a table that joins like any
other (``phi_dictionary``), which is the way for organisation lists too long for a literal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.policy import ConfigError, read_config
from cellward.session import literal_table

# ---- fixed values: the prohibited and allowed names of the Safe Harbor rules ----

DIRECT = """
patient_name first_name last_name middle_name given_name family_name full_name name maiden_name
birth_name legal_name
ssn social_security_number social_security_no social_sec_num
mrn medical_record_number medical_record_no patient_id chart_number record_id
health_plan_id beneficiary_id beneficiary_number subscriber_id subscriber_number member_id
member_number insurance_id policy_number
account_number account_no account_id billing_account
certificate_number license_number driver_license drivers_license dl_number professional_license
phone telephone phone_number tel_no tel mobile cell_phone home_phone work_phone contact_number
fax fax_number fax_no
email email_address email_addr e_mail
vehicle_id vin vehicle_identification_number license_plate plate_number
device_id serial_number device_serial serial_no imei mac_address device_identifier
url web_url website web_address uniform_resource_locator
ip_address ip_addr ip ipv4 ipv6 internet_protocol_address
fingerprint retinal_scan retina_scan iris_scan biometric biometric_id facial_image face_photo
photograph voiceprint voice_print
patient_key unique_id unique_identifier guid uuid token external_id
""".split()

GEOGRAPHIC = """
street_address address address_line_1 address_line_2 address_1 address_2 street street_name
street_number apt apartment unit suite building po_box
city town village municipality
county parish borough
zip zip_code zipcode postal_code zip_5 zip_9 full_zip
latitude longitude lat lon geocode geolocation coordinates
""".split()

DATES = """
birth_date birthdate date_of_birth dob birth_datetime month_of_birth day_of_birth
death_date date_of_death death_datetime deceased_date
admission_date discharge_date visit_date encounter_date service_date procedure_date
diagnosis_date lab_date test_date result_date
month day day_of_month day_of_week week quarter
timestamp datetime created_at updated_at modified_date
""".split()

GEOGRAPHIC_ALLOWED = (
    "state state_code state_abbr region division country country_code zip_3".split()
)
DATES_ALLOWED = "year year_of_birth year_of_death birth_year death_year age_in_years".split()

# Columns which the clinical catalog marks as prohibited although no list above names them.
CATALOG_ONLY_DIRECT = ["provider_name", "npi", "dea"]
CATALOG_ONLY_DATES = """
observation_period_start_date observation_period_end_date
visit_start_date visit_start_datetime visit_end_date visit_end_datetime
condition_start_date condition_start_datetime condition_end_date condition_end_datetime
drug_exposure_start_date drug_exposure_start_datetime drug_exposure_end_date
drug_exposure_end_datetime
procedure_datetime procedure_end_date procedure_end_datetime
measurement_date measurement_datetime
observation_date observation_datetime
""".split()

# Ordered: the first fragment found inside a direct identifier's name decides its label.
IDENTIFIER_TYPES = [
    ("name|first|last|given|family", "name (Category 1)"),
    ("ssn|social_security", "SSN (Category 7)"),
    ("mrn|medical_record", "medical record number (Category 8)"),
    ("phone|telephone|tel|fax", "telephone/fax number (Categories 4-5)"),
    ("email", "email address (Category 6)"),
    (
        "account|beneficiary|subscriber|member",
        "account/beneficiary number (Categories 9-10)",
    ),
    ("license|certificate|driver", "license/certificate number (Category 11)"),
    ("vehicle|vin|license_plate", "vehicle identifier (Category 12)"),
    ("device|serial", "device identifier (Category 13)"),
    ("url|web|ip|mac", "web/IP identifier (Categories 14-15)"),
    ("fingerprint|biometric|retinal|facial", "biometric identifier (Category 16)"),
]
OTHER_IDENTIFIER = "unique identifier (Category 18)"

# File sections of a custom vocabulary.
_SECTIONS = {
    "direct": "direct_identifiers",
    "geographic": "geographic_prohibited",
    "date": "date_prohibited",
}
CODES = {"direct": "E201", "geographic": "E202", "date": "E203"}

# ---- end of fixed values ----

PHI_DDL = (
    "name string, category string, allowed boolean, identifier_type string, source string"
)


def identifier_type_sql(name: str) -> str:
    """SQL text of ``identifier_type`` for a name given as SQL text."""
    cases = " ".join(f"WHEN {name} RLIKE '{f}' THEN '{label}'" for f, label in IDENTIFIER_TYPES)
    return f"CASE {cases} ELSE '{OTHER_IDENTIFIER}' END"


def identifier_type(name: Column) -> Column:
    """Label of a direct identifier, from its (lower-case) name."""
    label = None
    for fragments, text in IDENTIFIER_TYPES:
        hit = name.rlike(fragments)
        label = F.when(hit, text) if label is None else label.when(hit, text)
    return label.otherwise(OTHER_IDENTIFIER)


def normal_name(name: Column) -> Column:
    """Case, quoting and ``-``/``_`` do not matter when names are compared."""
    return F.translate(F.lower(name), '-"`', "_")


def _clean(names):
    cleaned = frozenset(str(n).strip().lower().replace("-", "_") for n in names or ())
    odd = sorted(n for n in cleaned if not re.fullmatch(r"[\w .$]+", n, re.ASCII))
    if odd:
        raise ConfigError("vocabulary", f"not usable as column names: {odd}")
    return cleaned


@dataclass(frozen=True)
class Vocabulary:
    direct: frozenset = field(default_factory=lambda: _clean(DIRECT))
    geographic: frozenset = field(default_factory=lambda: _clean(GEOGRAPHIC))
    date: frozenset = field(default_factory=lambda: _clean(DATES))
    gap_direct: frozenset = field(default_factory=lambda: _clean(CATALOG_ONLY_DIRECT))
    gap_date: frozenset = field(default_factory=lambda: _clean(CATALOG_ONLY_DATES))

    def names(self, category, strict=True):
        own = getattr(self, category)
        return own | getattr(self, f"gap_{category}", frozenset()) if strict else own

    def prohibited(self, strict=True):
        return frozenset().union(*(self.names(c, strict) for c in CODES))

    def extended(self, **more):
        """A wider vocabulary: ``vocab.extended(direct=["chart_ref"])``."""
        own = {c: getattr(self, c) for c in CODES}
        for category, names in more.items():
            own[category] = own[category] | _clean(names)
        return Vocabulary(**own, gap_direct=self.gap_direct, gap_date=self.gap_date)


DEFAULT = Vocabulary()


def load_vocabulary(path=None) -> Vocabulary:
    """Vocabulary from a YAML or JSON file; the built-in lists when there is no such file.

    A category which the file leaves out is empty.
    """
    if path is None:
        return DEFAULT
    try:
        config = read_config(path)
    except ConfigError as error:
        if isinstance(error.__cause__, FileNotFoundError):
            return DEFAULT
        raise
    lists = {}
    for category, section in _SECTIONS.items():
        found = config.get(section) or []
        if not isinstance(found, list):
            raise ConfigError(path, f"{section} must be a list of names")
        lists[category] = _clean(found)
    return Vocabulary(**lists)


def phi_dictionary(spark: SparkSession, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """One row per known name, allowed ones included."""
    rows = [
        (name, category, False, None, "phi_list")
        for category in CODES
        for name in sorted(getattr(vocab, category))
    ]
    rows += [(n, "direct", False, None, "catalog") for n in sorted(vocab.gap_direct)]
    rows += [(n, "date", False, None, "catalog") for n in sorted(vocab.gap_date)]
    rows += [(n, "geographic", True, None, "phi_list") for n in GEOGRAPHIC_ALLOWED]
    rows += [(n, "date", True, None, "phi_list") for n in DATES_ALLOWED]
    return literal_table(spark, rows, PHI_DDL).withColumn(
        "identifier_type",
        F.when(F.col("category") == "direct", identifier_type(F.col("name"))),
    )


def merge_dictionaries(base: DataFrame, custom: DataFrame) -> DataFrame:
    """Union of two dictionaries, one row per name; the base's row wins.

    ``custom`` may be any table with a ``name`` and a ``category`` column.
    """
    columns = base.columns
    extra = custom.select(
        normal_name(F.col("name")).alias("name"),
        F.col("category"),
        F.lit(False).alias("allowed"),
        F.when(
            F.col("category") == "direct", identifier_type(normal_name(F.col("name")))
        ).alias("identifier_type"),
        F.lit("custom").alias("source"),
    )
    ranked = base.withColumn("_rank", F.lit(0)).unionByName(extra.withColumn("_rank", F.lit(1)))
    rest = [c for c in columns if c != "name"]
    return (
        ranked.groupBy("name")
        .agg(F.min(F.struct("_rank", *rest)).alias("_row"))
        .select("name", *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*columns)
    )
