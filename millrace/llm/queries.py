"""Registry of the training-data queries and their SQL twins."""

from __future__ import annotations

from .decontamination import OP2_SQL, op2_decontamination
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .licences import op1_licences
from .packing import op3_packing
from .pii import op8_pii
from .sharding import op4_sharding
from .simhash import op9_simhash
from .tokens import op5_token_counts
from .toxicity import op10_toxicity
from .warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_licences": op1_licences,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_sharding": op4_sharding,
    "op5_token_counts": op5_token_counts,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_warc": op7_warc,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
}

ORACLES = {
    "op2_decontamination": OP2_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op7_warc": OP7_SQL,
}
