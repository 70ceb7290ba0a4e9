"""The training-data queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from noticeloom.llm.alignment import op12_alignment
from noticeloom.llm.divergence_audit import OP11_SQL, op11_divergence
from noticeloom.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from noticeloom.llm.license_scan import op2_license_scan
from noticeloom.llm.lm_scoring import OP13_SQL, op13_lm_scores
from noticeloom.llm.media import op10_media
from noticeloom.llm.mixing import OP4_SQL, op4_mixing
from noticeloom.llm.near_dedup import op9_near_dedup
from noticeloom.llm.packing import op8_packing
from noticeloom.llm.quality import op6_quality
from noticeloom.llm.sharding import op1_sharding
from noticeloom.llm.token_counts import op7_token_counts
from noticeloom.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_license_scan": op2_license_scan,
    "op3_warc": op3_warc,
    "op4_mixing": op4_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_packing": op8_packing,
    "op9_near_dedup": op9_near_dedup,
    "op10_media": op10_media,
    "op11_divergence": op11_divergence,
    "op12_alignment": op12_alignment,
    "op13_lm_scores": op13_lm_scores,
}
SQL = {
    "op3_warc": OP3_SQL,
    "op4_mixing": OP4_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op11_divergence": OP11_SQL,
    "op13_lm_scores": OP13_SQL,
}
