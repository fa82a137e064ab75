"""Survey response quality on Spark: careless-responding indices, flags, screens, composites and response times."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value: the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .frame import ResponseFrame  # noqa: E402
from .operators.flags import flag_scores  # noqa: E402
from .operators.index_flags import (  # noqa: E402
    acquiescence_flag, guttman_flag, individual_reliability_flag, infrequency_flag, lz_flag, mad_flag, mahad_summary, markov_flag, markov_summary, missing_rate_flag,
    onset_flag, psychsyn_summary, semantic_ant_flag, semantic_syn_flag,
)
from .operators.indices import (  # noqa: E402
    acquiescence, calculate_correlations, compute_person_correlations, evenodd, guttman, individual_reliability, infrequency, irv, longstring_pattern, longstring_scores, longstring_text, lz, mad, mahad,
    mahad_flag, mahad_qqplot, markov, midpoint_responding, missing_rate, onset, person_total, psychant, psychsyn, psychsyn_critval, response_pattern,
    semantic_ant, semantic_syn, summary, u3_poly,
)
from .operators.timing import (  # noqa: E402
    response_time, response_time_consistency, response_time_flag, response_time_mixture, response_time_score_flags,
)
from .plans.composite import CompositeResult, composite, composite_flag, composite_probability, composite_scores, composite_summary  # noqa: E402
from .plans.registry import IndexOptions, index_catalog  # noqa: E402
from .plans.screen import ScreenResult, screen, screen_scores  # noqa: E402
from .plots import plot_distributions, plot_flag_counts, plot_flagged_heatmap  # noqa: E402
from .sources.archive import Archive, load_response_time_archive, load_score_archive, save_response_time_archive, save_score_archive  # noqa: E402
from .sources.files import read_delimited, read_frame, read_npy  # noqa: E402
from .streaming.rowlocal import frozen_cutoffs, screen_stream  # noqa: E402
from .types import (  # noqa: E402
    BoolArray, CompositeMethod, CompositeSummary, FloatArray, IndexCatalog, IndexErrorMap, IndexFlagMap, IndexMetadata, IndexScoreMap, InfrequencyMissingPolicy, IntArray,
    MatrixLike, ResponseTimeFlagDirection, ResponseTimeMetric, ScoreArchiveResultType, ScreenIndexSummary,
)

#: Under the name that its callers know.
longstring = longstring_text
ScoreArchive = ResponseTimeArchive = Archive
__version__ = "0.2.0"

__all__ = [
    "BoolArray", "CompositeMethod", "CompositeSummary", "FloatArray", "IndexCatalog", "IndexErrorMap", "IndexFlagMap", "IndexMetadata", "IndexScoreMap", "InfrequencyMissingPolicy", "IntArray",
    "MatrixLike", "ResponseTimeArchive", "ResponseTimeFlagDirection", "ResponseTimeMetric", "ScoreArchive", "ScoreArchiveResultType", "ScreenIndexSummary",
    "plot_distributions", "plot_flag_counts", "plot_flagged_heatmap",
    "CompositeResult", "ScreenResult", "acquiescence_flag", "calculate_correlations", "compute_person_correlations", "guttman_flag", "individual_reliability_flag", "infrequency_flag",
    "longstring", "lz_flag", "mad_flag", "mahad_summary", "markov_flag", "markov_summary", "missing_rate_flag", "onset_flag", "psychsyn_summary", "semantic_ant_flag", "semantic_syn_flag",
    "IndexOptions", "ResponseFrame", "acquiescence", "composite", "composite_flag", "composite_probability", "composite_scores", "composite_summary", "evenodd",
    "flag_scores", "frozen_cutoffs", "guttman", "index_catalog", "individual_reliability", "infrequency", "irv", "load_response_time_archive",
    "load_score_archive", "longstring_pattern", "longstring_scores", "longstring_text", "lz", "mad", "mahad", "mahad_flag", "mahad_qqplot", "markov",
    "midpoint_responding", "missing_rate", "onset", "person_total", "psychant", "psychsyn", "psychsyn_critval", "read_delimited", "read_frame", "read_npy",
    "response_pattern", "response_time", "response_time_consistency", "response_time_flag", "response_time_mixture", "response_time_score_flags",
    "save_response_time_archive", "save_score_archive", "screen", "screen_scores", "screen_stream", "semantic_ant", "semantic_syn", "summary", "u3_poly",
]
