"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import context_tree, host_reputation, imatch, importance, infill, language_id, line_dedup, maxscore, mixing, packing, periodic_runs, simhash, weak_supervision

QUERIES = {
    "op1_importance": importance.op1_importance,
    "op10_language_id": language_id.op10_language_id,
    "op11_infill": infill.op11_infill,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_imatch": imatch.op13_imatch,
    "op2_simhash": simhash.op2_simhash,
    "op3_maxscore": maxscore.op3_maxscore,
    "op4_mix": mixing.op4_mix,
    "op5_packing": packing.op5_packing,
    "op6_context_tree": context_tree.op6_context_tree,
    "op7_host_reputation": host_reputation.op7_host_reputation,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_weak_supervision": weak_supervision.op9_weak_supervision,
}
SQL = {"op11_infill": infill.OP11_SQL, "op3_maxscore": maxscore.OP3_SQL, "op4_mix": mixing.OP4_SQL, "op7_host_reputation": host_reputation.OP7_SQL, "op8_line_dedup": line_dedup.OP8_SQL}
