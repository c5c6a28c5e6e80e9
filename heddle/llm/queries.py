"""The registered opN_ queries and their SQL."""

from heddle.llm.alignment import op11_striped_alignment
from heddle.llm.ann import op9_kmeans_tree
from heddle.llm.bpe import op3_bpe_transducer
from heddle.llm.gif import op10_gif_media
from heddle.llm.language_id import op8_byte_cnn
from heddle.llm.line_dedup import OP7_SQL, op7_line_dedup
from heddle.llm.lm import op4_log_bilinear
from heddle.llm.near_dup import op6_fast_similarity_sketch
from heddle.llm.packing import op2_best_fit_packing
from heddle.llm.pii import op5_crf_pii
from heddle.llm.quality import op1_weak_labels
from heddle.llm.token_files import op13_bit_packed
from heddle.llm.vector_codes import OP12_SQL, op12_delta_lloyd

QUERIES = {
    "op1_weak_labels": op1_weak_labels,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_bpe_transducer": op3_bpe_transducer,
    "op4_log_bilinear": op4_log_bilinear,
    "op5_crf_pii": op5_crf_pii,
    "op6_fast_similarity_sketch": op6_fast_similarity_sketch,
    "op7_line_dedup": op7_line_dedup,
    "op8_byte_cnn": op8_byte_cnn,
    "op9_kmeans_tree": op9_kmeans_tree,
    "op10_gif_media": op10_gif_media,
    "op11_striped_alignment": op11_striped_alignment,
    "op12_delta_lloyd": op12_delta_lloyd,
    "op13_bit_packed": op13_bit_packed,
}

ORACLE = {
    "op7_line_dedup": OP7_SQL,
    "op12_delta_lloyd": OP12_SQL,
}
