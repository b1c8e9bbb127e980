"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hardnegatives, linededup, trie
from .arrowfile import op5_arrowfile
from .chat import op8_chat
from .fingerprint import op6_fingerprint
from .hardnegatives import op11_hardnegatives
from .jaccardjoin import op4_jaccardjoin
from .linededup import op12_linededup
from .mixing import op2_mixing
from .neighbours import op10_neighbours
from .packing import op1_packing
from .quality import op3_quality
from .surrogates import op7_surrogates
from .trie import op13_trie
from .urlfilter import op9_urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_jaccardjoin": op4_jaccardjoin,
    "op5_arrowfile": op5_arrowfile,
    "op6_fingerprint": op6_fingerprint,
    "op7_surrogates": op7_surrogates,
    "op8_chat": op8_chat,
    "op9_urlfilter": op9_urlfilter,
    "op10_neighbours": op10_neighbours,
    "op11_hardnegatives": op11_hardnegatives,
    "op12_linededup": op12_linededup,
    "op13_trie": op13_trie,
}

ORACLE_SQL: dict[str, str] = {"op11_hardnegatives": hardnegatives.SQL, "op12_linededup": linededup.SQL, "op13_trie": trie.SQL}
