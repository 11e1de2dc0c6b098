"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from .fingerprints import op7_document_fingerprints
from .mixing import ORACLE as MIXING
from .mixing import op4_mixing
from .near_dedup import ORACLE as NEAR_DEDUP
from .near_dedup import op6_minhash_near_dedup
from .language_model import op10_lm_scoring
from .media import op9_media_columns
from .pii import op1_pii
from .quality import op5_quality
from .secrets import op2_secret_scans
from .sentencepiece_scan import op8_sentencepiece
from .toxicity import op3_toxicity

QUERIES = {f.__name__: f for f in (op1_pii, op2_secret_scans, op3_toxicity, op4_mixing, op5_quality, op6_minhash_near_dedup, op7_document_fingerprints, op8_sentencepiece, op9_media_columns, op10_lm_scoring)}
ORACLES: dict[str, str] = {"op4_mixing": MIXING, "op6_minhash_near_dedup": NEAR_DEDUP}
