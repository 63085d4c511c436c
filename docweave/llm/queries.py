"""The subpackage's registered queries and the SQL that checks them."""

from __future__ import annotations

from docweave.llm.chat import ORACLE as CHAT_SQL
from docweave.llm.chat import op3_chat_tree
from docweave.llm.decontam import ORACLE as DECONTAM_SQL
from docweave.llm.decontam import op2_decontaminate
from docweave.llm.linededup import ORACLE as LINES_SQL
from docweave.llm.linededup import op5_line_dedup
from docweave.llm.neardup import ORACLE as NEAR_SQL
from docweave.llm.neardup import op8_near_duplicates
from docweave.llm.packing import op1_pack
from docweave.llm.quality import ORACLE as QUALITY_SQL
from docweave.llm.quality import op7_quality_rules
from docweave.llm.secretscan import op4_secrets
from docweave.llm.substrings import ORACLE as SUBSTRINGS_SQL
from docweave.llm.substrings import op6_substring_dedup
from docweave.llm.tokenstore import op10_token_store
from docweave.llm.warc import ORACLE as WARC_SQL
from docweave.llm.warc import op9_warc

QUERIES = {f.__name__: f for f in (op1_pack, op2_decontaminate, op3_chat_tree, op4_secrets, op5_line_dedup, op6_substring_dedup, op7_quality_rules, op8_near_duplicates, op9_warc, op10_token_store)}
ORACLES: dict[str, str] = {"op2_decontaminate": DECONTAM_SQL, "op3_chat_tree": CHAT_SQL, "op5_line_dedup": LINES_SQL, "op6_substring_dedup": SUBSTRINGS_SQL, "op7_quality_rules": QUALITY_SQL, "op8_near_duplicates": NEAR_SQL, "op9_warc": WARC_SQL}
