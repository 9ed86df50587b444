"""Study settings: fixed values every operator takes its defaults from."""
from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: the classes, in code order 0..3, and the merchant codes (ISO 18245) of the named ones ----
CLASSES = ("Clothing", "Gas stations", "Food and grocery", "Other")
MERCHANT_CODE_RANGES = {
    "Clothing": ((5600, 5699), (5137, 5137), (5139, 5139), (5941, 5941)),
    "Gas stations": ((5541, 5542), (5983, 5983)),
    "Food and grocery": ((5400, 5499),),
}
INVALID_CODE = len(CLASSES)                 # an answer that is not one of the classes
SHORT_NAMES = ("clothing", "gas", "food", "other")      # column suffixes, in code order

# ---- fixed values: levels of the demographic tables ----
AGE_BANDS = ("<30", "30-39", "40-49", "50-59", "60+")
SPAN_BANDS = ("0-7 days", "8-30 days", "31-90 days", "over 90 days")
DEMOGRAPHIC_LEVELS = {
    "Age band": AGE_BANDS,
    "Gender": ("male", "female"),
    "Marital status": ("married", "single", "divorced or widowed", "unknown"),
    "Education": ("primary school", "middle school", "high school", "university", "graduate school", "unknown"),
    "Occupation": ("private sector employee", "public sector employee", "self-employed", "retired", "not employed",
                   "other occupation"),
    "Income group": ("low", "middle", "high"),
}

# ---- fixed values: column names of the input tables, and of what orders the purchases of one day ----
TRANSACTION_COLUMNS = ("customer_id", "date", "amount", "mcc")
DEMOGRAPHIC_COLUMNS = ("customer_id", "age", "gender", "marital_status", "education", "occupation", "income")
DEMOGRAPHIC_TEXT = ("gender", "marital_status", "education", "occupation")
DEMOGRAPHIC_FIELDS = ("gender", "age", "marital_status", "education", "occupation", "income_group")
TIE_BREAKERS = ("timestamp", "time", "transaction_id", "txn_id")     # the first one present orders one day

# ---- fixed values: models the learned answers are compared with ----
COMPARATORS = ("averaging", "last-category", "markov1", "lstm", "cnn", "sasrec", "dros-sasrec",
               "gbdt-seq", "gbdt-full", "logit-seq", "logit-full")


# ---- fixed values: the study's defaults, and decimals that texts may hold without a table ----
@dataclass(frozen=True)
class Settings:
    min_transactions: int = 10
    diversity_window: int = 10              # nine inputs and the target
    min_distinct: int = 2
    train_pool: int = 50_000
    val_fraction: float = 0.2
    in_bank_test: int = 10_000
    earlier_test: int = 1_000
    seed: int = 42
    train_length: int = 9
    lengths: tuple = (4, 7, 9, 14)
    currency: str = "TL"
    few_shot_per_class: int = 4
    bootstrap_draws: int = 10_000
    mde_factor: float = 2.80
    psi_floor: float = 1e-6
    psi_bins: int = 10
    ece_bins: int = 15
    cost_miss: float = 5.0
    cost_false_alarm: float = 1.0
    trace_ignore: tuple = field(default=("0.05", "0.95", "0.80", "1.96", "2.80", "0.10", "0.25"))


DEFAULTS = Settings()
