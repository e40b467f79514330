"""Operations for large training-data pipelines, and their queries."""

from marginalia.llm.alignment import op13_token_alignment
from marginalia.llm.bpe import op1_byte_bpe
from marginalia.llm.cws import op2_weighted_fingerprints
from marginalia.llm.ecoc import op10_ecoc_langid
from marginalia.llm.hilbert import op4_hilbert_shards
from marginalia.llm.line_quality import OP6_SQL, op6_line_quality
from marginalia.llm.minmax import op9_minmax_dedup
from marginalia.llm.negatives import op11_anchor_tree_negatives
from marginalia.llm.packing import op8_cutting_stock
from marginalia.llm.pii import op5_pii_spans
from marginalia.llm.pitman_yor import op7_pitman_yor
from marginalia.llm.suffix_dedup import op3_substring_dedup
from marginalia.llm.warc import op12_warc_chain

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_weighted_fingerprints": op2_weighted_fingerprints,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_pii_spans": op5_pii_spans,
    "op6_line_quality": op6_line_quality,
    "op7_pitman_yor": op7_pitman_yor,
    "op8_cutting_stock": op8_cutting_stock,
    "op9_minmax_dedup": op9_minmax_dedup,
    "op10_ecoc_langid": op10_ecoc_langid,
    "op11_anchor_tree_negatives": op11_anchor_tree_negatives,
    "op12_warc_chain": op12_warc_chain,
    "op13_token_alignment": op13_token_alignment,
}
#: DuckDB SQL of those queries that SQL can express.
ORACLES: dict[str, str] = {"op6_line_quality": OP6_SQL}
