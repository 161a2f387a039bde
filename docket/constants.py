"""Words, thresholds and shapes that results depend on."""

from __future__ import annotations

# Fields of a packet, and what stands in a field that nothing was found for.
CONTENT_FIELDS = ["applicant_name", "species_code", "home_world", "visa_class", "sponsor_id", "arrival_date", "declared_purpose", "risk_flags", "fee_status"]
PLACEHOLDER = {
    "applicant_name": "unknown", "species_code": "unknown", "home_world": "unknown", "visa_class": "unknown", "sponsor_id": "SPN-0000",
    "arrival_date": "1900-01-01", "declared_purpose": "unknown", "risk_flags": "none", "fee_status": "unknown",
}
OUTPUT_ORDER = ["case_id", *CONTENT_FIELDS, "adjudication", "confidence"]

# Decisions, in the order of probability vectors.
DECISIONS = ["APPROVED", "DENIED", "NEEDS_REVIEW"]

# Page types with the rank of their evidence and the words of their headers.
PAGE_TYPES = [
    ("note", 2, ["manualadjudicatornote", "adjudicatornote"]),
    ("intake", 2, ["formi8090", "extraterrestrialworkauthorization", "primaryintakerecord"]),
    ("fee", 2, ["mibfeereceipt", "feereceipt"]),
    ("slip", 3, ["formb13", "biometricscanslip"]),
    ("sponsor", 4, ["sponsorattestationletter", "attestationletter"]),
    ("registry", 5, ["planetaryregistryextract", "registryextract"]),
]
PAGE_RANK = {"note": 2, "intake": 2, "fee": 2, "slip": 3, "sponsor": 4, "registry": 5, "other": 6}
CORRECTION_RANK, FOREIGN_RANK = 1, 9
HEADER_RATIO = 0.68

# Labels of fields, labels that are no fields, and how near a reading must be.
FIELD_ALIASES = {
    "applicant_name": ["applicant", "applicantname", "registryname", "name", "applicantnamе", "intakename"],
    "species_code": ["speciescode", "speciesmatch", "species"],
    "home_world": ["homeworld", "worldoforigin", "planetoforigin", "world"],
    "visa_class": ["visaclass", "class", "visatype"],
    "sponsor_id": ["sponsorid", "sponsor"],
    "arrival_date": ["arrivaldate", "dateofarrival", "arrival"],
    "declared_purpose": ["declaredpurpose", "purpose", "statedpurpose"],
    "fee_status": ["feestatus", "fee", "paymentstatus"],
}
DECOY_LABELS = [
    "caseid", "case", "packet", "page", "biometricconfidence", "observedflags", "registrystatus", "amount", "waivercode", "finding", "reason", "form",
    "scanimage", "passportimage", "registryimage", "note", "status", "syntheticchallengedocument", "mibeyesonly", "issued", "expires", "signature",
    "signed", "stamp", "date", "confidence", "match", "registry", "image", "passport", "scan", "primaryintakerecord", "intake", "sample", "denial",
    "archive", "copy", "artifact", "redacted", "casework",
]
LABEL_RATIO, LABEL_MARGIN, LABEL_LIKE, LABEL_LENGTH = 0.74, 0.02, 0.82, 40

# Weights of evidence by rank, and the similarity at which free texts are one reading.
RANK_WEIGHT = {1: 6.0, 2: 1.0, 3: 1.0, 4: 0.7, 5: 0.9, 6: 0.3, 9: 0.05}
CONFIDENCE_POWER = 3
CLUSTER_RATIO = 0.80

# Characters that OCR takes for digits in ids and dates, and in sponsor ids.
ID_DIGITS = ("OoQDIl|iSsBZG", "0000111155826")
SPONSOR_DIGITS = ("oODQlIi|!LZzSsBbGgqT?Ae", "00001111112255866997748")

# Closed vocabularies, the similarity a field asks for, and the margin over the next best.
VOCABULARY = {
    "declared_purpose": ["reactor maintenance", "field repair", "medical consult", "translation", "research", "diplomatic", "cultural exchange", "xenobotany", "archive audit", "transit"],
    "fee_status": ["paid", "waived", "unpaid"],
    "home_world": ["Europa Station", "Luyten-b", "Titan Freeport", "Barnard-c", "Kepler-186f", "Gliese-581g", "Mars Dome-7", "Wolf-1061c", "Proxima-b", "Sirius Outpost", "Zeta Reticuli", "TRAPPIST-1e", "Eris Relay"],
    "species_code": ["TRIANGULAN", "ORION_GRAYS", "LUNA_SECURID", "ALPHA_DRACONIAN", "VENUSIAN_MYCELIAL", "CENTAURI_SYNTH", "JOVIAN_GASFORM", "KAIJU_MICRO", "SIRIUS_AVIAN", "ARCTURIAN", "ANDROMEDAN", "AQUARIAN_MANTIS"],
    "visa_class": ["MED-3", "DIP-1", "XW-1", "XW-2", "TRANSIT-7"],
}
SIMILARITY = {"visa_class": 0.85, "fee_status": 0.80, "declared_purpose": 0.72, "species_code": 0.72, "home_world": 0.72}
SIMILARITY_ELSE, SIMILARITY_MARGIN = 0.80, 0.06
CONTAINED_KEY, CONTAINING_KEY = 4, 8
NULLISH = ["", "unknown", "none", "null", "n/a", "na", "-", "--"]

# Fields whose spacing may be repaired, and the shortest key for it.
RESPACED_FIELDS = ["applicant_name", "declared_purpose", "home_world"]
RESPACE_KEY, RESPACE_TOKEN, NEAR_RATIO = 5, 2, 0.72

# Risk flags, and thresholds of their detection.
DISQUALIFYING = ["memory_tampering", "planetary_embargo", "active_warrant", "biohazard_red"]
REVIEW_ONLY = ["identity_conflict", "sponsor_mismatch", "illegible_biometrics", "rescinded_denial"]
FLAGS = sorted(DISQUALIFYING + REVIEW_ONLY)
ANCHOR_RATIO, FLAG_RATIO, FLAG_RATIO_LOW, NONE_RATIO, NOTE_FLAG_RATIO, NAME_CONFIDENCE, NAME_RATIO, SLIP_RATIO = 0.60, 0.62, 0.55, 0.65, 0.70, 0.97, 0.60, 0.62
FURNITURE = "scanimage|scantab|packet|synthetic|casework|archive|copyartifact|redacted|sampledenial|sampledenia|intake|filed|image"

# Strings that forms print, and policy.
RAW_STRINGS = {
    "raw_fee_unpaid": ["feestatusunpaid"], "raw_fee_unknown": ["feestatusunknown"], "raw_fee_paid": ["feestatuspaid"], "raw_fee_waived": ["feestatuswaived"],
    "raw_waivercode_na": ["waivercodena"], "raw_visa_transit": ["visaclasstransit", "classtransit"], "raw_visa_dip": ["visaclassdip", "classdip1"],
    "raw_observed_any": ["observedflags"], "raw_observed_none": ["observedflagsnone"], "raw_registry_clear": ["registrystatusclear"],
    "raw_registry_embargo": ["registrystatusembargoreview", "embargoreview"], "raw_diplomatic": ["diplomatic"], "raw_hardship": ["hardship"],
    "raw_rescind": ["rescind"], "raw_revoked": ["revoked"],
    "raw_sponsor_standing": ["sponsorstandingrequiresadditionalverification", "standingrequiresadditional"], "raw_amount_zero": ["amount000", "amountna"],
}
REVOKED_SPONSORS = ["SPN-0007", "SPN-0139", "SPN-4040"]

# Decision words of notes, reasons as notes print them, and how near a reading must be.
DECISION_WORDS = {"denied": "DENIED", "approved": "APPROVED", "needsreview": "NEEDS_REVIEW"}
REASONS = {
    "dq_flag": "disqualifyingriskflag", "ro_flag": "reviewonlyriskflagpresent", "transit": "transitclasscannotauthorize", "embargo_world": "embargohomeworld",
    "revoked_spn": "revokedsponsor", "fee_unpaid": "mandatoryfeeunpaid", "fee_unknown": "feestatusunknown", "date_missing": "arrivaldatemissingfromtrustedvisibleevidence",
    "damaged": "packetcontainsdamagedorcontradictoryvisibleevidence", "clean": "cleanorexceptionqualifiedpacket", "appr_survive": "approvalsupportedbysurvivingvisibleevidence",
    "deny_damaged": "denialsupportedbydamagedregistryevidence", "ambiguous": "ambiguouspacket", "rescinded": "priordenialstamprescinded",
}
FINDING_RATIO, DECISION_RATIO, REASON_ANCHOR_RATIO, REASON_RATIO = 0.72, 0.62, 0.75, 0.78

# Points for (action, truth) in the order of DECISIONS, before the penalty of a false approval is set.
PAYOFF = [[8.0, None, 1.0], [0.0, 8.0, 1.0], [2.0, 2.0, 8.0]]
CAUTION_MODES = ["off", "dis", "dis_all", "any", "any_all"]

# How corrections begin, and how near a stem or a label must be.
CORRECTION_STEM, CORRECTION_RATIO = "manualcorrection", 0.80

# Tokens of stamps and watermarks, the longest line that can be one, and how near a misread one must be.
STAMP_TOKENS = {
    "denied": ["denied", "denial"], "approved": ["approved", "approval"], "needsreview": ["needsreview"], "sampledenial": ["sampledenial"],
    "rescind": ["rescinded", "rescind"], "void": ["void", "revoked"], "casework": ["casework"], "archive": ["archive", "archivecopy"],
    "redacted": ["redacted"], "copyartifact": ["copyartifact", "duplicate"], "embargo": ["embargo"], "hardship": ["hardship"],
}
STAMP_LENGTH, STAMP_RATIO = 34, 0.78

# Words that say evidence is damaged, lines that are no body text, and the labels that a page of each type prints.
DAMAGE_WORDS = ["washedout", "whiteout", "redacted", "illegible", "torn", "unreadable", "missing", "damaged", "obscured"]
PAGE_FURNITURE = ("synthetichiring", "packetmib")
PAGE_LABELS = {
    "intake": ["caseid", "applicant", "speciescode", "homeworld", "visaclass", "sponsorid", "arrivaldate", "declaredpurpose"],
    "registry": ["registryname", "homeworld", "speciescode", "registrystatus", "arrivaldate"],
    "slip": ["caseid", "applicant", "speciesmatch", "biometricconfidence", "observedflags"],
    "fee": ["caseid", "feestatus", "amount", "waivercode"],
    "note": ["finding", "reason"],
}

# Page types whose disagreement matters, pairs of types that are compared, and how near free texts must be.
SOURCE_TYPES = ["intake", "registry", "slip", "sponsor", "fee", "note", "correction"]
SOURCE_PAIRS = [("intake", "registry"), ("intake", "slip"), ("intake", "sponsor"), ("registry", "slip")]
SOURCE_RATIO = 0.80

# Where a fee status comes from, and marks that a line of a page may hold.
FEE_SOURCES = ["anchored", "line_scan", "receipt_arithmetic", "prior"]
PAGE_MARKS = ["denied", "approved", "needsreview", "rescind", "sampledenial", "redacted", "copyartifact", "casework", "archive", "embargo", "hardship", "waiver", "diplomaticnote", "revoked"]

# Patterns of dates, visa classes, sponsor ids, destroyed fields, amounts and waiver codes as forms print or misprint them.
DATE_PATTERN = r"([0-9OQIlSB]{4})\s*[-/. ]\s*([0-9OQIlSB]{1,2})\s*[-/. ]\s*([0-9OQIlSB]{1,2})"
VISA_PATTERN = r"(XW[-\s]?[12]|DIP[-\s]?1|MED[-\s]?3|TRANSIT[-\s]?7)"
SPONSOR_PLAIN = r"(?i)SPN[\s\-_.:]*([A-Za-z0-9|!?]{4})"
SPONSOR_TOKEN = r"\b([A-Za-z0-9$5]{3})[\s\-_.:]*([A-Za-z0-9|!?]{4})\b"
SPONSOR_MISREAD = r"(?i)\b[S5$][PF][NM][-\s.]?([0-9OQIlSB]{4})\b"
REDACTED_WORDS = r"(name|registry|species|world|purpose|sponsor|data|field|value)?\s*(cut\s*out|cutout|whiteout|white\s*out|lost|redacted|illegible|missing|destroyed|torn|unreadable|removed)"
AMOUNT_PATTERN = r"\$\s*([\d,]+)\s*[.,]\s*(\d\d)"
WAIVER_CODE = r"(?i)waiver\s*code\W*(.{0,12})"
