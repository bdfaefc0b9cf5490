"""Queries of this subpackage over the given tables, and SQL for those that SQL can express."""

from corvane.llm.bpe import op10_byte_bpe
from corvane.llm.decontaminate import op4_decontamination
from corvane.llm.licenses import op3_license_scan
from corvane.llm.minhash import op5_minhash_near_dedup
from corvane.llm.mixing import op11_mixing
from corvane.llm.oracles import OP1_SQL, OP4_SQL, OP5_SQL, OP7_SQL, OP8_SQL, OP9_SQL, OP13_SQL
from corvane.llm.quality import op8_quality_rules
from corvane.llm.sharding import op2_sharding
from corvane.llm.store import op6_token_store
from corvane.llm.substring import op7_substring_dedup
from corvane.llm.suffixes import op9_suffix_dedup
from corvane.llm.trie import op13_prefix_trie
from corvane.llm.warc import op1_warc
from corvane.llm.whitening import op12_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_sharding,
        op3_license_scan,
        op4_decontamination,
        op5_minhash_near_dedup,
        op6_token_store,
        op7_substring_dedup,
        op8_quality_rules,
        op9_suffix_dedup,
        op10_byte_bpe,
        op11_mixing,
        op12_whitening,
        op13_prefix_trie,
    )
}
#: Packing (2), labels (3), merges (6, 10), block selection (11) and eigenvectors (12) are beyond plain SQL; tests hold them against brute force.
ORACLES = {
    "op1_warc": OP1_SQL,
    "op4_decontamination": OP4_SQL,
    "op5_minhash_near_dedup": OP5_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op8_quality_rules": OP8_SQL,
    "op9_suffix_dedup": OP9_SQL,
    "op13_prefix_trie": OP13_SQL,
}
