"""Table sinks: CSV, Parquet, Markdown, LaTeX."""

from __future__ import annotations

from pyspark.sql import DataFrame

LIMIT = 10_000  # rows that a rendered table may have; more is an error, not a cut


def _cells(df: DataFrame) -> list[list[str]]:
    rows = df.limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError(f"a rendered table has {LIMIT} rows at most")
    return [["" if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in r] for r in rows]


def markdown(df: DataFrame) -> str:
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, _cells(df))]) + "\n"


def latex(df: DataFrame, comment: str = "") -> str:
    escape = lambda c: "".join({"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$"}.get(x, x) for x in c)
    row = lambda cells: " & ".join(map(escape, cells)) + r" \\"
    body = "\n".join(map(row, _cells(df)))
    head = f"% {comment}\n" if comment else ""
    return f"{head}\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{row(df.columns)}\n\\hline\n{body}\n\\end{{tabular}}\n"


def export(df: DataFrame, base: str, formats: tuple[str, ...] = ("csv", "parquet")) -> dict[str, str]:
    """Write the table in each format under ``base`` and return the paths. Nothing is overwritten."""
    out = {}
    for kind in formats:
        path = f"{base}.{kind}"
        if kind == "csv":
            df.write.option("header", True).csv(path)
        elif kind == "parquet":
            df.write.parquet(path)
        elif kind in ("md", "tex"):
            text = markdown(df) if kind == "md" else latex(df)
            df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
        else:
            raise ValueError(f"no such format: {kind}")
        out[kind] = path
    return out


def paper_table(df: DataFrame, base: str, caption: str, note: str = "") -> dict[str, str]:
    """A table of a paper as Markdown, under its caption and over its note, and as LaTeX with both as comments. Nothing is overwritten."""
    texts = {"md": f"**{caption}**\n\n{markdown(df)}" + (f"\n{note}\n" if note else ""), "tex": latex(df, " ".join(f"{caption} {note}".split()))}
    out = {}
    for kind, text in texts.items():
        out[kind] = f"{base}.{kind}"
        df.sparkSession.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.text(out[kind])
    return out


def report(title: str, sections: dict[str, DataFrame | str]) -> str:
    """A Markdown report: a heading and a table, or a paragraph, for each section."""
    parts = [f"# {title}\n"]
    for name, body in sections.items():
        parts.append(f"## {name}\n\n{body.strip() if isinstance(body, str) else markdown(body).strip()}\n")
    return "\n".join(parts)
