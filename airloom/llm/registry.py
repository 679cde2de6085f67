"""The corpus operators' queries."""

from .bpe import op4_bpe_chunk_reuse
from .centroid_clustering import op12_exponion_clusters
from .chat import op5_role_repair
from .decontaminate import op10_spaced_seeds
from .importance import op1_gumbel_resampling
from .language_id import op9_output_codes
from .lexical_search import op13_threshold_seeded_search
from .oracles import oracle_sql  # noqa: F401
from .pii import op3_semi_markov_crf
from .quality_rules import op7_quality_host_rules
from .simhash_dedup import op8_simhash_popcount
from .substring_dedup import op6_window_doubling
from .url_filter import op2_association_rules
from .warc import op11_warc_zstandard

QUERIES = [
    op1_gumbel_resampling,
    op2_association_rules,
    op3_semi_markov_crf,
    op4_bpe_chunk_reuse,
    op5_role_repair,
    op6_window_doubling,
    op7_quality_host_rules,
    op8_simhash_popcount,
    op9_output_codes,
    op10_spaced_seeds,
    op11_warc_zstandard,
    op12_exponion_clusters,
    op13_threshold_seeded_search,
]


def queries():
    return {f.__name__: f for f in QUERIES}
