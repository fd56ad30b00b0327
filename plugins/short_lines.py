"""Example of a plugin: lines shorter than 0.1 m, often slips of digitising."""

from pyspark.sql import functions as F

from assay.functions import geometry
from assay.plans.checks import shapes, spatial
from assay.plans.run import Run, check


@check("quality", "Very short lines", 200)
def short_lines(run: Run) -> None:
    main = run.state.get("main")
    limit = 0.1 / ((main.unit_m if main is not None else None) or 1.0)
    bad = total = 0
    for name in spatial(run, "line"):
        if "subnet" in name.lower():
            continue
        size = geometry.length(F.col("g"))
        short = shapes(run, name).where((size > 0) & (size < limit))
        n, total = short.count(), total + run.rows(name)
        run.log(f"{name}: {n} short lines")
        if n:
            bad += n
            run.find("warning", f"{n} lines are shorter than 0.1 m", name, n, run.ids(short, "id"), threshold=f"{limit:g}")
            run.flag(name, short, "warning", "very short line", 60)
    run.score(100.0 * (1 - bad / total) if total else None, 0.5)
