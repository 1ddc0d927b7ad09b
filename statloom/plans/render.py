"""The SQL of a session's steps, as a chain of common table expressions."""

from __future__ import annotations

from statloom.functions import aggregate
from statloom.operators import combining, rows, summaries
from statloom.plans.expressions import Scope, quote, to_sql
from statloom.plans.frame import Frame, Key
from statloom.plans.script import Command


class _Shown(Scope):
    """A scope that writes whole-dataset terms as plain windows."""

    def time_term(self, x: str, k: int, over: str) -> str:
        return f"{'lag' if k < 0 else 'lead'}({x}, {abs(k)}) {over}"

    def whole_term(self, kind: str, arg: str, k: int = 0) -> str:
        order = f"ORDER BY {', '.join(self.order)}"
        if kind == "n":
            return f"row_number() OVER ({order})"
        if kind == "N":
            return "count(1) OVER ()"
        if kind == "shift":
            return f"{'lag' if k < 0 else 'lead'}({arg}, {abs(k)}) OVER ({order})"
        if kind == "at":
            return f"nth_value({arg}, {k}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        return f"{aggregate.plain(kind, arg)} OVER ({order} ROWS UNBOUNDED PRECEDING)"


def _sql(frame: Frame, text: str, c: Command, panel, running: bool = True) -> str:
    plain = frame.scope(c.by, c.by_sort, panel)
    order = tuple(o for o in plain.order if not o.startswith("`__")) or ("monotonically_increasing_id()",)
    return to_sql(text, _Shown(plain.columns, plain.by, order, panel, running=running))


def _list(names: list[str]) -> str:
    return ", ".join(quote(n) for n in names)


def step_sql(c: Command, before: Frame, after: Frame, panel, source: str | None = None) -> str:
    """The SELECT of one step over ``{prev}``."""
    verb, prev = c.verb, "{prev}"
    where = f" WHERE {_sql(before, c.cond, c, panel)}" if c.cond else ""
    if verb in ("keep", "drop") and c.cond:
        cond = _sql(before, c.cond, c, panel)
        test = f"NOT ({cond})" if verb == "drop" else cond
        shown = _list(after.columns)
        if " OVER (" in cond:
            return f"SELECT {shown} FROM (SELECT *, {test} AS __if FROM {prev}) WHERE __if"
        return f"SELECT {shown} FROM {prev} WHERE {test}"
    if verb in ("keep", "drop", "order"):
        return f"SELECT {_list(after.columns)} FROM {prev}"
    if verb == "rename":
        old, new = before.resolve(c.names()[0]), c.names()[1]
        return f"SELECT {_list([x for x in before.columns if x != old])}, {quote(old)} AS {quote(new)} FROM {prev}"
    if verb in ("generate", "replace"):
        name, expression = rows.assignment(c.head)
        text = f"CASE WHEN {c.cond} THEN {expression} ELSE {'NULL' if verb == 'generate' else f'`{name}`'} END" if c.cond else expression
        value = _sql(before, text, c, panel)
        if verb == "generate":
            return f"SELECT {_list(before.columns)}, {value} AS {quote(name)} FROM {prev}"
        return "SELECT " + ", ".join(f"{value} AS {quote(x)}" if x == before.resolve(name) else quote(x) for x in before.columns) + f" FROM {prev}"
    if verb == "sort":
        keys = ", ".join(Key(before.resolve(n), c.has("desc")).sql() for n in c.names())
        return f"SELECT * FROM {prev} ORDER BY {keys}"
    if verb == "mvencode":
        value = _sql(before, c.options.get("mv") or "0", c, panel)
        names = before.columns if c.names() == ["_all"] else [before.resolve(n) for n in c.names()]
        return "SELECT " + ", ".join(f"coalesce({quote(x)}, {value}) AS {quote(x)}" if x in names else quote(x) for x in before.columns) + f" FROM {prev}"
    if verb == "collapse":
        by = [before.resolve(n) for n in (c.option_names("by") or list(c.by))]
        out = [quote(g) for g in by]
        for function, new, arg in summaries.targets(c.head):
            out.append(f"{aggregate.plain({'firstnm': 'first', 'lastnm': 'last'}.get(function.lower(), function), _sql(before, arg, c, panel, False))} AS {quote(new)}")
        return f"SELECT {', '.join(out)} FROM {prev}{where}" + (f" GROUP BY {_list(by)} ORDER BY {', '.join(Key(g).sql() for g in by)}" if by else "")
    if verb == "egen":
        name, call = rows.assignment(c.head)
        function, _, arg = call.partition("(")
        by = [before.resolve(n) for n in (c.option_names("by") or list(c.by))]
        value = f"{aggregate.plain(function.strip(), _sql(before, arg.rstrip().rstrip(')'), c, panel, False))} OVER ({'PARTITION BY ' + _list(by) if by else ''})"
        if c.cond:
            value = f"CASE WHEN {_sql(before, c.cond, c, panel)} THEN {value} END"
        return f"SELECT {_list(before.columns)}, {value} AS {quote(name)} FROM {prev}"
    if verb == "duplicates":
        names = [before.resolve(n) for n in c.names()[1:]]
        if not names:
            return f"SELECT DISTINCT * FROM {prev}"
        order = ", ".join(k.sql() for k in before.order if not k.column.startswith("__")) or "monotonically_increasing_id()"
        return f"SELECT {_list(before.columns)} FROM (SELECT *, row_number() OVER (PARTITION BY {_list(names)} ORDER BY {order}) AS __rn FROM {prev}) WHERE __rn = 1"
    if verb == "expand":
        copies = f"LATERAL VIEW posexplode(array_repeat(0, CAST(coalesce({_sql(before, c.head, c, panel)}, 0) AS INT))) __x AS __copy, __zero"
        flag = (c.option_names("generate", "gen") or [None])[0]
        return f"SELECT {_list(before.columns)}{f', CASE WHEN __copy > 0 THEN 1 ELSE 0 END AS {quote(flag)}' if flag else ''} FROM {prev} {copies}"
    if verb == "append":
        return f"SELECT * FROM {prev} UNION ALL BY NAME SELECT * FROM {source}"
    if verb in ("merge", "joinby"):
        words, _ = combining.using_parts(c)
        keys = [before.resolve(k) for k in (words[1:] if verb == "merge" else words)]
        extra = [n for n in after.columns if n not in before.columns and n != "_merge"]
        kept = {combining._CODES[w.lower()] for w in c.option_names("keep")} or {1, 2, 3}
        how = "INNER" if verb == "joinby" or kept == {3} else "LEFT" if 2 not in kept else "RIGHT" if 1 not in kept else "FULL"
        code = "CASE WHEN __m AND __u THEN 3 WHEN __m THEN 1 ELSE 2 END"
        shown = [f"coalesce(m.{quote(n)}, u.{quote(n)}) AS {quote(n)}" if n in keys else f"m.{quote(n)}" for n in before.columns] + [f"u.{quote(n)}" for n in extra]
        body = f"SELECT {', '.join(shown)}{f', {code} AS _merge' if '_merge' in after.columns and '_merge' not in before.columns else ''}"
        on = " AND ".join(f"m.{quote(k)} = u.{quote(k)}" for k in keys)
        sql = f"{body} FROM (SELECT *, true AS __m FROM {prev}) m {how} JOIN (SELECT {_list([*keys, *extra])}, true AS __u FROM {source}) u ON {on}"
        if verb == "merge" and kept not in ({3}, {1, 3}, {2, 3}, {1, 2, 3}):
            sql += f" WHERE {code} IN ({', '.join(map(str, sorted(kept)))})"
        return sql
    if verb == "reshape":
        return f"SELECT {_list(after.columns)} FROM {prev} /* {c.head} */"
    if verb == "recode":
        return f"SELECT {_list(after.columns)} FROM {prev} /* {c.head} */"
    return f"SELECT * FROM {prev}"


_CLAUSES = (" FROM ", " WHERE ", " GROUP BY ", " ORDER BY ", " UNION ALL BY NAME ", " LATERAL VIEW ")


def _broken(body: str, indent: str) -> str:
    """A SELECT with each top-level clause on its own line."""
    out, depth, i, quote_char = [], 0, 0, ""
    while i < len(body):
        c = body[i]
        if quote_char:
            quote_char = "" if c == quote_char else quote_char
        elif c in "'`":
            quote_char = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == " " and not depth:
            clause = next((k for k in _CLAUSES if body.startswith(k, i)), None)
            if clause:
                out.append("\n" + indent)
                i += 1
                continue
        out.append(c)
        i += 1
    return indent + "".join(out)


def chain_sql(steps: list[tuple[str, str]], comments: bool = True, broken: bool = True) -> str:
    """One query from (command, SELECT) of each step."""
    parts = []
    for n, (text, body) in enumerate(steps):
        body = body.replace("{prev}", f"_s{n - 1}")
        note = f"  -- [source] {text}\n" if comments else ""
        parts.append(f"{note}  _s{n} AS (\n{_broken(body, '    ')}\n  )" if broken else f"_s{n} AS ({body})")
    last = f"SELECT * FROM _s{len(steps) - 1}"
    return "WITH\n" + ",\n".join(parts) + "\n" + last if broken else "WITH " + ", ".join(parts) + " " + last
