"""The queries of this subpackage and the SQL of those that SQL can express."""

from folioflow.llm.alignment import op12_alignment
from folioflow.llm.conversations import OP13_SQL, op13_conversations
from folioflow.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from folioflow.llm.fingerprints import op7_fingerprints
from folioflow.llm.language import op11_language
from folioflow.llm.mixing import op8_mixing
from folioflow.llm.near_dedup import op10_near_dedup
from folioflow.llm.packing import op1_packing
from folioflow.llm.quality import op3_quality
from folioflow.llm.secrets import op4_secrets
from folioflow.llm.sharding import op5_sharding
from folioflow.llm.substring_dedup import op6_substring_dedup
from folioflow.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_sharding": op5_sharding,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_mixing": op8_mixing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_language": op11_language,
    "op12_alignment": op12_alignment,
    "op13_conversations": op13_conversations,
}
SQL = {"op2_warc": OP2_SQL, "op9_exact_dedup": OP9_SQL, "op13_conversations": OP13_SQL}
