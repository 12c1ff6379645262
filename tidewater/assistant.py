"""Questions in words: answered as SQL if they are, else by a language model that is given. Nothing but a
single SELECT that a model returns is run."""

from __future__ import annotations

import re
from collections.abc import Callable

from tidewater.errors import EngineError
from tidewater.plans.dialect import significant, statements
from tidewater.session import Engine

MOST_ROWS = 100
_FENCE = re.compile(r"```sql\s*(.*?)```", re.DOTALL | re.IGNORECASE)


class Assistant:
    """model: from a prompt to a text with a fenced SQL statement; none unless one is given."""

    def __init__(self, engine: Engine, model: Callable[[str], str] | None = None):
        self.engine, self.model = engine, model

    def schema(self) -> str:
        return "\n".join(f"{t}({', '.join(f'{c.name} {c.kind}' for c in self.engine.describe(t).columns)})" for t in self.engine.tables())

    def reply(self, message: str) -> dict:
        if message.strip().lower() in ("tables", "schema", "show tables", "show schema"):
            return {"text": self.schema() or "There are no tables."}
        if re.match(r"\s*(select|with)\b", message, re.IGNORECASE):
            return self._run(message)
        if self.model is None:
            return {"text": "No language model is set up; ask in SQL."}
        text = self.model(f"Tables:\n{self.schema()}\n\nAnswer with one SELECT in a ```sql fence.\n\n{message}")
        found = _FENCE.search(text)
        return self._run(found[1], text) if found else {"text": text}

    def _run(self, sql: str, text: str = "") -> dict:
        try:
            several = statements(sql)
            if len(several) != 1 or significant(several[0])[0].word not in ("SELECT", "WITH"):
                return {"text": text, "error": "only a single SELECT is run"}
            df = self.engine.sql(several[0])
            rows = [list(r) for r in df.limit(MOST_ROWS + 1).collect()]
            more = {"truncated": f"only the first {MOST_ROWS} rows are shown"} if len(rows) > MOST_ROWS else {}
            return {"text": text, "sql": several[0], "columns": df.columns, "rows": rows[:MOST_ROWS]} | more
        except EngineError as e:
            return {"text": text, "sql": sql, "error": str(e)}
