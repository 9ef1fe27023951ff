"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import op1_vafile, op3_chat
from .op2_minhash import op2_minhash
from .op4_pii import op4_pii
from .op5_toxicity import op5_toxicity
from .op6_imatch import op6_imatch
from .op7_packing import op7_packing
from .op8_langid import op8_langid
from .op9_suffix import op9_suffix
from .op10_mixing import op10_mixing


def queries() -> dict:
    ops = (op1_vafile.op1_vafile, op2_minhash, op3_chat.op3_chat, op4_pii, op5_toxicity, op6_imatch, op7_packing, op8_langid, op9_suffix, op10_mixing)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_vafile": op1_vafile.SQL, "op3_chat": op3_chat.SQL}
