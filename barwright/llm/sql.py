"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

from barwright.llm.line_dedup import CLEANED_SQL
from barwright.llm.negatives import NEGATIVES_SQL
from barwright.llm.urls import judge_urls_sql


ORACLES: dict[str, str] = {
    "op10_url_filter": judge_urls_sql(),
    "op11_line_dedup": CLEANED_SQL,
    "op12_hard_negatives": NEGATIVES_SQL,
}
