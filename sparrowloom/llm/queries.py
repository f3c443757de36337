"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .chat_events import OP4_SQL, op4_chat_events
from .context_pii import op7_context_pii
from .fair_mix import OP8_SQL, op8_fair_mix
from .license_scan import op1_license_scan
from .line_crf import op3_line_crf
from .part_codes import OP12_SQL, op12_part_codes
from .simhash_join import op5_simhash
from .site_quality import OP6_SQL, op6_site_quality
from .suffix_tree_lm import op2_suffix_tree_lm
from .template_leaks import op9_template_leaks
from .token_lengths import op10_token_lengths
from .turn_repair import OP11_SQL, op11_turn_repair
from .uniform_shards import op13_uniform_shards

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_suffix_tree_lm, op3_line_crf, op4_chat_events, op5_simhash, op6_site_quality, op7_context_pii, op8_fair_mix, op9_template_leaks, op10_token_lengths, op11_turn_repair, op12_part_codes, op13_uniform_shards)}
SQL: dict[str, str] = {"op4_chat_events": OP4_SQL, "op6_site_quality": OP6_SQL, "op8_fair_mix": OP8_SQL, "op11_turn_repair": OP11_SQL, "op12_part_codes": OP12_SQL}
