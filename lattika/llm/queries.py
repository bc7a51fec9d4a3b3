"""The registered queries of the subpackage and the SQL that checks those which SQL can express."""

from __future__ import annotations

from lattika.llm.ann import op3_ann
from lattika.llm.fingerprints import op11_fingerprints
from lattika.llm.language import op6_language
from lattika.llm.minhash import OP10_SQL, op10_minhash
from lattika.llm.mixing import OP2_SQL, op2_mixing
from lattika.llm.packing import op1_packing
from lattika.llm.quality import OP8_SQL, op8_quality
from lattika.llm.ranking import OP13_SQL, op13_ranking
from lattika.llm.scoring import op9_scoring
from lattika.llm.secrets import OP4_SQL, op4_secrets
from lattika.llm.token_files import op5_token_files
from lattika.llm.warc import OP7_SQL, op7_warc
from lattika.llm.whitening import op12_whitening

QUERIES = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_ann": op3_ann,
    "op4_secrets": op4_secrets,
    "op5_token_files": op5_token_files,
    "op6_language": op6_language,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_scoring": op9_scoring,
    "op10_minhash": op10_minhash,
    "op11_fingerprints": op11_fingerprints,
    "op12_whitening": op12_whitening,
    "op13_ranking": op13_ranking,
}

ORACLE_SQL = {"op2_mixing": OP2_SQL, "op4_secrets": OP4_SQL, "op7_warc": OP7_SQL, "op8_quality": OP8_SQL, "op10_minhash": OP10_SQL, "op13_ranking": OP13_SQL}
