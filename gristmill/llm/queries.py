"""Registry: one query per operator, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from gristmill.llm.attention_lm import op4_attention_lm
from gristmill.llm.centroids import OP11_SQL, op11_centroids
from gristmill.llm.crf_quality import op8_crf_quality
from gristmill.llm.funnels import OP12_SQL, op12_funnels
from gristmill.llm.gif_media import op1_gif_media
from gristmill.llm.lang_mixture import op9_lang_mixture
from gristmill.llm.line_dedup import OP6_SQL, op6_line_dedup
from gristmill.llm.packing import op7_packing
from gristmill.llm.parity_join import op13_parity_join
from gristmill.llm.parity_sql import OP13_SQL
from gristmill.llm.pareto_mix import OP10_SQL, op10_pareto_mix
from gristmill.llm.secret_markov import op3_secret_markov
from gristmill.llm.simhash_gray import op2_simhash_gray
from gristmill.llm.toxic_cnn import op5_toxic_cnn

QUERIES = {
    "op1_gif_media": op1_gif_media,
    "op2_simhash_gray": op2_simhash_gray,
    "op3_secret_markov": op3_secret_markov,
    "op4_attention_lm": op4_attention_lm,
    "op5_toxic_cnn": op5_toxic_cnn,
    "op6_line_dedup": op6_line_dedup,
    "op7_packing": op7_packing,
    "op8_crf_quality": op8_crf_quality,
    "op9_lang_mixture": op9_lang_mixture,
    "op10_pareto_mix": op10_pareto_mix,
    "op11_centroids": op11_centroids,
    "op12_funnels": op12_funnels,
    "op13_parity_join": op13_parity_join,
}

ORACLE_SQL = {
    "op6_line_dedup": OP6_SQL,
    "op10_pareto_mix": OP10_SQL,
    "op11_centroids": OP11_SQL,
    "op12_funnels": OP12_SQL,
    "op13_parity_join": OP13_SQL,
}
