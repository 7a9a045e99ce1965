"""Results as text, LaTeX and HTML tables, and as files."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

from tiewise.operators.estimation import Fit


def _cells(fit: Fit, digits: int) -> list[tuple[str, ...]]:
    number = lambda x: f"{x:.{digits}f}"
    return [(t.of, t.kind, t.short, number(a), number(b) if b > 0 else "fixed", number(c)) for t, a, b, c in zip(fit.terms, fit.theta, fit.se, fit.t_ratios, strict=True)]


_HEAD = ("variable", "type", "effect", "estimate", "se", "t ratio")


def as_text(fit: Fit, digits: int = 4) -> str:
    """Aligned columns, and the convergence below them."""
    rows = [_HEAD, *_cells(fit, digits)]
    wide = [max(map(len, c)) for c in zip(*rows, strict=True)]
    lines = ["  ".join(x.ljust(w) if k < 3 else x.rjust(w) for k, (x, w) in enumerate(zip(r, wide, strict=True))) for r in rows]
    return "\n".join([*lines, f"largest t ratio of a combination: {fit.overall_ratio:.{digits}f}", f"simulations: {fit.iterations}", ""])


def as_latex(fit: Fit, digits: int = 4) -> str:
    safe = lambda x: x.replace("_", "\\_")
    lines = [" & ".join(map(safe, r)) + r" \\" for r in _cells(fit, digits)]
    return "\n".join([r"\begin{tabular}{lllrrr}", " & ".join(_HEAD) + r" \\ \hline", *lines, r"\end{tabular}", ""])


def as_html(fit: Fit, digits: int = 4) -> str:
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
    return "\n".join(["<table>", row(_HEAD, "th"), *(row(r, "td") for r in _cells(fit, digits)), "</table>", ""])


def write(df: DataFrame, path: str, format: str = "csv") -> None:
    """A report's rows as files of a folder, by Spark's writers."""
    if format not in ("csv", "json", "parquet"):
        raise ValueError(f"{format}: no such format")
    out = df.write.mode("overwrite")
    out.option("header", True).csv(path) if format == "csv" else getattr(out, format)(path)
