"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .annsearch import op2_hnsw
from .bitslice import OP11_SQL, op11_bit_sliced
from .importance import OP13_SQL, op13_resampling
from .infill import OP12_SQL, op12_infill
from .langid import op8_string_kernel
from .linededup import OP9_SQL, op9_line_runs
from .media import op4_ogg_media
from .mixing import op5_soft_mixing
from .ngramjoin import op1_ngram_join
from .packing import op10_packing
from .pii import op3_weak_pii
from .sharding import op7_histogram_shards
from .urlfilter import OP6_SQL, op6_url_filter

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_hnsw": op2_hnsw,
    "op3_weak_pii": op3_weak_pii,
    "op4_ogg_media": op4_ogg_media,
    "op5_soft_mixing": op5_soft_mixing,
    "op6_url_filter": op6_url_filter,
    "op7_histogram_shards": op7_histogram_shards,
    "op8_string_kernel": op8_string_kernel,
    "op9_line_runs": op9_line_runs,
    "op10_packing": op10_packing,
    "op11_bit_sliced": op11_bit_sliced,
    "op12_infill": op12_infill,
    "op13_resampling": op13_resampling,
}

ORACLE_SQL = {"op6_url_filter": OP6_SQL, "op9_line_runs": OP9_SQL, "op11_bit_sliced": OP11_SQL, "op12_infill": OP12_SQL, "op13_resampling": OP13_SQL}
