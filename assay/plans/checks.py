"""Checks of the staged run that work from the dataset's catalog and geometry.

Catalog tables, all optional (a check without its table does nothing):
``items`` (name, type), ``types`` (uuid, label), ``registered`` (name, has_cdf, has_table);
``definitions`` (class, kind, documentation, has_z, has_m, xy_tolerance), ``workspace`` (documentation);
``class_fields`` (class, kind, field, type, domain, nullable, required), ``domains`` (name, field_type);
``crs`` (layer, wkt), ``model_crs`` (model, wkt); ``models`` (model and the columns of class_fields);
``match_table`` (type, SubstringsA, SubstringsB, match_strings), ``class_map`` (source_class, target_class, rows);
``references`` (layer, field, type, domain), ``subtypes`` (layer, subtype_field, code, name, field, domain), ``domain_codes``, ``domain_ranges``;
``baseline`` (class_name, asset_group, asset_type); ``isconnected_codes`` (layer, code, label).
They are sizes of schemas, so what a check gathers from them is small; layers are
only ever aggregated, and geometry is a column ``geometry`` (a shape or WKB) of the
layers named in ``Dataset.geometry``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import documents, geometry, projection, scoring
from assay.functions.text import is_system, number
from assay.operators import assets, conformance, dates, domains, lineage, mapping, network, references, trust, uniqueness
from assay.plans.run import Run, check
from assay.sources import dataset as source
from assay.sources.scratch import kept

#: Layers that are no part of a network, point layers that are its junctions, labels of a code for "not connected".
NETWORK_EXCLUDE = re.compile("subnetline|serviceterritory|dirtyarea|boundary", re.IGNORECASE)
JUNCTION_HINT = re.compile("junction|device|breaker|disconnect|tap|switch|fuse|valve|fitting|transformer|connector", re.IGNORECASE)
NOT_CONNECTED = "(?i)disconnect|not connected"
LABELS = {
    "summary": "Summary", "description": "Description", "tags": "Tags", "credits": "Credits", "use_limits": "Use limits", "contact": "Contact", "extent": "Extent", "lineage": "Lineage",
}
_URGENT = ("description", "summary", "tags", "use_limits", "contact")


def _names(values, shown: int = 60) -> str:
    return ", ".join(sorted(values)[:shown])


def shapes(run: Run, layer: str, where: Column | None = None) -> DataFrame:
    """(id, g) of a layer's rows, or of those where a condition holds, that have a geometry column."""
    df = run.dataset.frames[layer]
    df = df if where is None else df.where(where)
    g = F.col(run.fields(df)["geometry"])
    if df.schema[run.fields(df)["geometry"]].dataType.typeName() == "binary":
        g = geometry.from_wkb(g)
    return df.select(F.col(df.columns[0]).alias("id"), g.alias("g"))


def spatial(run: Run, kind: str | None = None) -> list[str]:
    return sorted(n for n, df in run.layers(kind).items() if n in run.dataset.geometry and "geometry" in run.fields(df))


def systems(run: Run) -> dict[str, object]:
    """layer -> its described coordinate system, for spatial layers; read once a run."""
    if "systems" not in run.state:
        table, mine = run.dataset.catalog.get("crs"), spatial(run)
        wkt = {r.layer.lower(): r.wkt for r in table.collect()} if table is not None else {}
        rows = run.dataset.spark.createDataFrame([(n, wkt.get(n.lower())) for n in mine] or [("", None)], "layer string, wkt string")
        run.state["systems"] = {r.layer: r for r in rows.select("layer", "wkt", documents.crs(F.col("wkt")).alias("c")).select("layer", "wkt", "c.*").collect() if r.layer}
    return run.state["systems"]


def bounds(shape: DataFrame):
    v = F.explode(geometry.vertices(F.col("g"))).alias("v")
    return shape.select(v).agg(F.min("v.x").alias("west"), F.min("v.y").alias("south"), F.max("v.x").alias("east"), F.max("v.y").alias("north")).head()


def fits(system, box) -> bool:
    """Whether coordinates could be of a system: degrees lie in the globe's range, a projected system's coordinates beyond it."""
    if box is None or box.west is None:
        return True
    degrees = box.west >= -540 and box.east <= 540 and box.south >= -90.5 and box.north <= 90.5
    return degrees if system.geographic else not degrees


def dominant(found: dict) -> str | None:
    """The most frequent horizontal system; of those alike the one of the first layer."""
    n: dict[str, int] = {}
    for s in found.values():
        if s.defined and s.horizontal:
            n[s.horizontal] = n.get(s.horizontal, 0) + 1
    return max(n, key=lambda k: n[k]) if n else None


# ---- discover -------------------------------------------------------------------------------------


@check("discover", "Catalog", 20)
def catalog(run: Run) -> None:
    """Catalog items by kind; registered tables that cannot be listed."""
    items, types, registered = (run.dataset.catalog.get(k) for k in ("items", "types", "registered"))
    if items is not None and types is not None:
        run.tables["items"] = source.catalog_items(items, types)
    if registered is not None:
        listed = run.dataset.spark.createDataFrame([(r.layer,) for r in run.inventory()], "layer string")
        for r in source.missing_tables(registered, listed).orderBy("name").collect():
            run.find(r.severity, f"{r.name} is registered but missing: {r.reason}", r.name)
    kind = source.dataset_kind([r.layer for r in run.inventory()], any(re.match("UN_\\d+_", r.layer, re.IGNORECASE) for r in run.inventory()), run.dataset.name)
    run.state["kind"] = kind
    run.log(f"kind of dataset: {kind}")


@check("discover", "Match reference model", 30)
def match_model(run: Run) -> None:
    """The reference model that fits best; its fields serve later checks."""
    models, fields = run.dataset.catalog.get("models"), class_fields(run)
    if models is None or fields is None:
        return
    ranked = conformance.match_models(fields, models, run.dataset.name)
    run.tables["models"] = ranked
    best = ranked.where("rank = 1").head()
    if best is None or best.score < 0.5:
        run.find("info", "No reference model fits the dataset")
        return
    run.state["model"] = best.model
    run.find("info", f"Best reference model: {best.model}", detail=f"score {best.score}", confidence=min(1.0, best.score / 4))


def class_fields(run: Run) -> DataFrame | None:
    """The catalog's class_fields without system classes, or what the layers' schemas say."""
    table = run.dataset.catalog.get("class_fields")
    if table is not None:
        return table.where(~is_system(F.col("class")))
    rows = [(n, run.dataset.geometry.get(n, "table"), f.name, f.dataType.simpleString(), None, f.nullable, False) for n, df in run.layers().items() for f in df.schema]
    return run.dataset.spark.createDataFrame(rows, "class string, kind string, field string, type string, domain string, nullable boolean, required boolean") if rows else None


# ---- metadata -------------------------------------------------------------------------------------


@check("metadata", "Layer coordinate systems", 1)
def layer_crs(run: Run) -> None:
    found = systems(run)
    main = dominant(found)
    if not found or main is None:
        return
    reference = next(s for s in found.values() if s.horizontal == main)
    odd = [n for n, s in found.items() if s.defined and s.horizontal != main]
    for n in odd:
        box = bounds(shapes(run, n))
        wrong = not fits(found[n], box) and fits(reference, box)
        more = "; its coordinates only fit the dominant system, so its own is wrong" if wrong else ""
        run.find("error", f"{n} declares {found[n].horizontal}, but the dataset uses {main}{more}", n, 1, action="Correct the layer's coordinate system, or project it to the dataset's.")
    run.score(100.0 * (1 - len(odd) / len(found)))


@check("metadata", "Item metadata", 10)
def item_metadata(run: Run) -> None:
    table = run.dataset.catalog.get("definitions")
    if table is None:
        return
    scored = table.where(~is_system(F.col("class"))).select("class", "kind", F.coalesce(F.length(F.trim("documentation")) > 0, F.lit(False)).alias("has_xml"), documents.metadata(F.col("documentation")).alias("m"))
    scored = scored.select("class", "kind", "has_xml", "m.*", F.when(F.col("has_xml"), documents.metadata_score(F.col("m"), run.rules["weights"]["metadata_elements"])).otherwise(0.0).alias("score"))
    run.tables["metadata_items"] = scored.orderBy(F.col("kind") != "Feature Class", F.lower("class"))
    rows = scored.collect()
    if not rows:
        run.find("info", "No classes or tables to evaluate")
        return
    spatial_ = [r for r in rows if r.kind == "Feature Class"]
    for what, mine, severity in (("feature classes", spatial_, "error"), ("tables", [r for r in rows if r.kind != "Feature Class"], "warning")):
        bare = [r["class"] for r in mine if not r.has_xml]
        if bare:
            run.find(severity, f"No metadata on {len(bare)} of {len(mine)} {what}", count=len(bare), detail=_names(bare))
    told = [r for r in rows if r.has_xml]
    for k, label in LABELS.items():
        lacking, hollow = [r["class"] for r in told if r[k] in ("missing", "placeholder")], [r["class"] for r in told if r[k] == "placeholder"]
        if lacking:
            run.find("warning" if k in _URGENT else "info", f"{label} missing on {len(lacking)} of {len(told)} documented items", count=len(lacking), detail=_names(lacking, 80))
        if hollow:
            run.find("info", f"{label} holds template text on {len(hollow)} items", count=len(hollow), detail=_names(hollow, 80))
    empty = [r["class"] for r in told if r.score <= 10]
    if empty:
        run.find("warning", f"{len(empty)} items carry only metadata that tools wrote", count=len(empty), detail=_names(empty, 80))
    weight = {r["class"]: 2 if r.kind == "Feature Class" else 1 for r in rows}
    run.score(sum(r.score * weight[r["class"]] for r in rows) / sum(weight[r["class"]] for r in rows), 4)


@check("metadata", "Dataset metadata", 20)
def workspace_metadata(run: Run) -> None:
    table = run.dataset.catalog.get("workspace")
    if table is None:
        return
    row = table.select(documents.metadata(F.col("documentation")).alias("m")).select("m.*", documents.metadata_score(F.col("m"), run.rules["weights"]["metadata_elements"]).alias("score")).head()
    if row is None or row.standard is None:
        run.find("warning", "The dataset's own metadata is missing")
        run.score(0.0)
        return
    lacking = [label for k, label in LABELS.items() if row[k] != "present"]
    if lacking:
        run.find("info", f"The dataset's metadata lacks: {', '.join(lacking)}", count=len(lacking))
    run.score(row.score)


# ---- lineage --------------------------------------------------------------------------------------


@check("lineage", "CRS consistency", 10)
def crs_consistency(run: Run) -> None:
    found = systems(run)
    if not found:
        return
    z = {r["class"].lower(): bool(r.has_z) for r in run.dataset.catalog["definitions"].collect()} if "definitions" in run.dataset.catalog else {}
    rows = [(n, s.horizontal if s.defined else None, s.vertical, z.get(n.lower(), False), s.geographic, i) for i, (n, s) in enumerate(found.items())]
    table = run.dataset.spark.createDataFrame(rows, "layer string, horizontal string, vertical string, has_z boolean, geographic boolean, pos int")
    run.tables["crs"] = run.dataset.spark.createDataFrame([(n, s.horizontal, s.epsg, s.vertical, s.unit) for n, s in found.items()], "layer string, horizontal string, epsg int, vertical string, units string")
    r = lineage.crs_deductions(table).head()
    main = dominant(found)
    bare = [n for n, s in found.items() if not s.defined]
    if r.undefined:
        run.find("error", f"{r.undefined} spatial layers have no coordinate system", count=r.undefined, detail=_names(bare))
    if r.horizontals > 1:
        odd = [n for n, s in found.items() if s.defined and s.horizontal != main]
        run.find("error", f"Mixed horizontal systems: {r.horizontals}", count=len(odd), detail=_names(odd))
    if r.verticals > 1:
        run.find("warning", f"Layers differ in their vertical system: {r.verticals}", count=r.verticals)
    if r.flat_z:
        high = [n for n in found if z.get(n.lower())]
        run.find("warning", f"{len(high)} layers store heights, but no vertical system is defined", count=len(high), detail=_names(high))
    if r.geographic_main:
        run.find("warning", f"The data are in degrees ({main}); so are lengths and tolerances")
    if main:
        run.state["main"] = next(s for s in found.values() if s.horizontal == main)
    run.score(r.score, 2)


@check("lineage", "CRS and reference model", 20)
def crs_vs_model(run: Run) -> None:
    table, main, model = run.dataset.catalog.get("model_crs"), run.state.get("main"), run.state.get("model")
    target = None if table is None or main is None or model is None else table.where(F.col("model") == model).select(documents.crs(F.col("wkt")).alias("c")).select("c.*").head()
    if target is None or not target.defined:
        return
    score = 100.0
    if main.horizontal != target.horizontal:
        if main.datum != target.datum:
            run.find("warning", f"The datum differs from the model's ({main.datum} and {target.datum}): loading needs a transformation", detail=f"{main.horizontal} to {target.horizontal}")
            score -= 40
        else:
            run.find("info", f"The projection differs from the model's ({main.horizontal} and {target.horizontal}), not the datum")
            score -= 15
    if (main.vertical or None) != (target.vertical or None):
        run.find("info", f"The vertical system differs from the model's ({main.vertical or 'none'} and {target.vertical or 'none'})")
        score -= 10
    run.score(score)


@check("lineage", "Provenance", 30)
def provenance(run: Run) -> None:
    mine = {n: run.dataset.frames[n] for n in spatial(run)}
    if not mine:
        return
    untracked = [n for n, df in mine.items() if not set(run.fields(df)) & set(lineage.EDIT_FIELDS)]
    if untracked:
        run.find("info", f"{len(untracked)} layers have no edit-tracking fields", count=len(untracked), detail=_names(untracked))
    dated = [(df, [c for low, c in run.fields(df).items() if low in ("last_edited_date", "lastupdate", "editdate", "created_date", "creationdate")]) for n, df in mine.items() if n not in untracked]
    dated = [(df, c) for df, c in dated if c]
    if dated:
        run.tables["edit_span"] = dates.span(dated)
    run.score(100.0 * (1 - len(untracked) / len(mine)), 0.5)


@check("lineage", "Field mapping", 40)
def field_mapping(run: Run) -> None:
    match, book, models, model = (run.dataset.catalog.get("match_table"), run.dataset.catalog.get("class_map"), run.dataset.catalog.get("models"), run.state.get("model"))
    if match is None and book is None or models is None or model is None:
        return
    spark = run.dataset.spark
    targets = models.where(F.col("model") == model).select("class", "field")
    fields = spark.createDataFrame([(n, f) for n, df in run.layers().items() for f in df.columns], "layer string, field string")
    alias = mapping.aliases(match) if match is not None else spark.createDataFrame([], "source string, target string")
    if match is not None:
        stray = mapping.stray_space(match.select("match_strings")).count()
        if stray:
            run.find("info", f"The match table has {stray} rows with stray white space", count=stray)
        for side, severity, what in (("target", "warning", f"maps to {{}} fields that {model} lacks"), ("source", "info", "names {} source fields that the dataset lacks")):
            bad = [r.name for r in mapping.unknown_names(alias, fields, targets).where(F.col("side") == side).collect()]
            if bad:
                run.find(severity, f"The match table {what.format(len(bad))}", count=len(bad), detail=_names(bad))
    classes = spark.createDataFrame([], "layer string, class string")
    if book is not None:
        actual = spark.createDataFrame([(r.layer, r.rows) for r in run.inventory() if r.readable], "layer string, rows long")
        for r in mapping.row_counts(book, actual).orderBy("class").collect():
            if r.status == "missing":
                run.find("warning", f"The mapping book lists {r['class']}, which the dataset lacks", r["class"])
            elif r.status == "differs" and r.expected:
                run.find("info", f"The mapping book expects {r.expected} rows of {r['class']}, the dataset has {r.actual}", r["class"], abs(r.expected - r.actual))
        lost = [r.name for r in references.absent(book.where("target_class is not null").select(F.lower("target_class").alias("name")).distinct(), targets.select(F.col("class").alias("name"))).collect()]
        if lost:
            run.find("error", f"The mapping book targets {len(lost)} classes that {model} lacks", count=len(lost), detail=_names(lost))
        bare = [r.name for r in references.absent(spark.createDataFrame([(n,) for n in run.layers()], "name string"), book.select(F.col("source_class").alias("name"))).collect()]
        if bare:
            run.find("warning", f"{len(bare)} layers with data have no class mapping", count=len(bare), detail=_names(bare))
        names = fields.select("layer").distinct()
        classes = names.join(book, F.lower("layer") == F.lower("source_class")).join(targets.select("class").distinct(), F.lower("class") == F.lower("target_class")).select("layer", "class").distinct()
    covered = mapping.coverage(fields, targets, alias, classes)
    run.tables["mapping"] = covered
    rows = covered.orderBy("layer").collect()
    for r in rows:
        if r.coverage < 50:
            run.find("warning", f"Only {r.mapped} of {r.fields} fields of {r.layer} map to the model", r.layer, r.fields - r.mapped)
    weight = sum(run.rows(r.layer) for r in rows)
    run.score(sum(r.coverage * run.rows(r.layer) for r in rows) / weight if weight else None, 2)


# ---- schema ---------------------------------------------------------------------------------------


@check("schema", "Domain integrity", 10)
def domain_integrity(run: Run) -> None:
    refs, known = run.dataset.catalog.get("references"), run.dataset.catalog.get("domains")
    if refs is None or known is None:
        return
    lost, wrong, idle = (x.collect() for x in (domains.missing_domains(refs, known), domains.mismatched_domains(refs, known), domains.unused_domains(refs, known)))
    score = 100.0
    if lost:
        run.find("error", f"{len(lost)} references point to domains that do not exist", count=len(lost), detail="; ".join(sorted({f"{r.layer}.{r.field} -> {r.domain}" for r in lost})[:60]))
        score -= min(60, 5 * len(lost))
    if wrong:
        run.find("warning", f"{len(wrong)} fields use a domain of another type", count=len(wrong), detail="; ".join(sorted(f"{r.layer}.{r.field} ({r.field_family}) uses {r.domain} ({r.domain_family})" for r in wrong)[:60]))
        score -= min(30, 3 * len(wrong))
    if idle:
        run.find("info", f"{len(idle)} domains are not used by any field", count=len(idle), detail=_names((r.name for r in idle), 100))
    run.score(score)


@check("schema", "Reference model", 30)
def model_conformance(run: Run) -> None:
    models, model, mine = run.dataset.catalog.get("models"), run.state.get("model"), class_fields(run)
    if models is None or model is None or mine is None:
        return
    want = models.where(F.col("model") == model).drop("model")
    pairs = conformance.counterparts(mine, want)
    fields = conformance.field_conformance(mine, want, pairs)
    run.tables["conformance"] = scores = conformance.conformance_scores(fields)
    kinds = {
        "missing required": ("error", "lacks {} required fields of"), "missing": ("warning", "lacks {} fields of"), "extra": ("info", "has {} fields that are not in"),
        "type": ("warning", "has {} fields of another type than"), "domain": ("info", "has {} fields with another domain than"),
    }
    grouped = fields.where("status <> 'ok'").groupBy("class", "status").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list("field")), 1, 60), ", ").alias("names"))
    other = {r["class"]: r.counterpart for r in pairs.collect()}
    for r in grouped.orderBy("class", "status").collect():
        severity, words = kinds[r.status]
        run.find(severity, f"{r['class']} {words.format(r.n)} {model}/{other[r['class']]}", r["class"], r.n, detail=r.names)
    rows = scores.collect()
    if not rows:
        run.find("warning", f"No class corresponds to {model}")
        run.score(0.0)
        return
    absent = references.absent(want.where("lower(kind) <> 'table'").select(F.col("class").alias("name")).distinct(), mine.select(F.col("class").alias("name"))).collect()
    if absent:
        run.find("info", f"{len(absent)} classes of the model are not in the dataset", count=len(absent), detail=_names(r.name for r in absent))
    run.score(sum(r.score * max(1, r.fields) for r in rows) / sum(max(1, r.fields) for r in rows), 2)


@check("schema", "Asset types", 90)
def asset_types(run: Run) -> None:
    base = run.dataset.catalog.get("baseline")
    if base is None:
        run.find("info", "No baseline of asset types, so they were not compared", rule="no asset baseline")
        return
    parts = [assets.pairs(df, n, run.fields(df)["assetgroup"], run.fields(df)["assettype"]) for n, df in run.layers().items() if {"assetgroup", "assettype"} <= set(run.fields(df))]
    if not parts:
        return
    found = assets.exact(trust.union(*parts), base)
    near = assets.fuzzy(found.where("not matched").drop("matched"), base)
    key = ["class_name", "asset_group", "asset_type"]
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    every = found.alias("a").join(near.select(*key, "match_group", "match_type", "confidence").alias("b"), on[0] & on[1] & on[2], "left")
    state = F.when(F.col("matched"), "exact").when(F.col("b.confidence").isNotNull(), "fuzzy").otherwise("unmapped")
    run.tables["asset_mapping"] = table = every.select(*[f"a.{k}" for k in key], "a.features", state.alias("match"), "b.match_group", "b.match_type", F.when(F.col("matched"), 1.0).otherwise(F.coalesce("b.confidence", F.lit(0.0))).alias("confidence"))
    for r in table.where("match = 'fuzzy'").orderBy(*key).collect():
        label = f"{r.asset_group or '?'} / {r.asset_type or '?'}"
        run.find(
            run.severity("fuzzy_asset_type"), f"{label} is close to {r.match_group} / {r.match_type}", r.class_name, r.features, rule=f"fuzzy {label}", confidence=r.confidence,
            method="name similarity against the baseline", threshold=str(assets.FUZZY), action="Confirm the proposed group and type, then use those names.",
        )
    for r in assets.unmapped_labels(table.where("match = 'unmapped'")).orderBy("class_name").collect():
        run.find(run.severity("unmapped_asset_type"), f"{r.n} asset types are not in the baseline", r.class_name, r.n, rule="unmapped asset type", evidence=r.labels)
    lost = assets.missing_groups(found, base).groupBy("class_name").agg(F.array_sort(F.collect_set("asset_group")).alias("g")).orderBy("class_name")
    for r in lost.collect():
        run.find(run.severity("missing_asset_group"), f"{len(r.g)} asset groups of the baseline are not used", r.class_name, len(r.g), rule="missing asset group", evidence=", ".join(r.g[:20]))


# ---- quality --------------------------------------------------------------------------------------


@check("quality", "Geometry validity", 30)
def geometry_validity(run: Run) -> None:
    """One pass over each layer: null, invalid, zero-length and zero-area shapes by kind; stacked points."""
    bad = total = 0
    for n in spatial(run):
        kind = run.dataset.geometry[n].lower()
        g, df = F.col("g"), shapes(run, n)
        empty = geometry.is_empty(g)
        reason = geometry.invalid_reason(F.lit(kind), g) if "point" not in kind else F.lit(None).cast("string")
        zero = geometry.length(g) == 0 if "line" in kind else geometry.area(g) == 0 if "polygon" in kind else F.lit(False)
        judged = df.select("id", "g", empty.alias("empty"), F.when(~empty, reason).alias("reason"), (~empty & zero).alias("zero"))
        facts = judged.groupBy(F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("rows"), F.count_if("empty").alias("empty"), F.count_if("zero").alias("zero")).collect()
        total += sum(r.rows for r in facts)
        if any(r.reason or r.empty or r.zero for r in facts):
            judged = kept(judged.where("empty or reason is not null or zero"))  # few; their ids and shapes are asked for several times
        reasons = {r.reason: r.rows for r in facts if r.reason}
        counts = (("empty", sum(r.empty for r in facts), "{} rows have null or empty geometry", ""), ("reason is not null", sum(reasons.values()), "{} invalid shapes", "; ".join(f"{k} x{v}" for k, v in sorted(reasons.items(), key=lambda x: (-x[1], x[0]))[:5])),
                  ("zero", sum(r.zero for r in facts), "{} zero-length lines" if "line" in kind else "{} zero-area polygons", ""))
        for test, k, words, detail in counts:
            if k:
                bad += k
                run.find("error", words.format(k), n, k, run.ids(judged.where(test), "id"), detail)
                if test != "empty":
                    run.flag(n, judged.where(test).select("id", "g"), "error", words.format("").strip(), 100)
        if "point" in kind and df.where(~empty & (F.size(g) > 1)).limit(1).count() == 0:  # single-part points only
            v = F.element_at(geometry.vertices(g), 1)
            stacked = network.stacked_points(df.where(~empty).select(v.x.alias("x"), v.y.alias("y"))).agg(F.coalesce(F.sum("members"), F.lit(0)).alias("n")).head().n
            if stacked:
                run.find("info", f"{stacked} points lie on another point of their class", n, stacked)
    run.score(scoring.penalty_of(bad, total), 2)


def aligned(run: Run, layer: str, reference) -> DataFrame | None:
    """(id, g) of a layer in the reference system; None where it cannot be brought there.

    Degrees, transverse Mercator (UTM), Lambert conformal conic and Mercator systems are converted into each other;
    a layer whose coordinates fit only the reference system is taken as mislabelled.
    """
    shape, own = shapes(run, layer).where(~geometry.is_empty(F.col("g"))), systems(run).get(layer)
    if reference is None or own is None or not own.defined or own.horizontal == reference.horizontal:
        return shape
    box = bounds(shape)
    if not fits(own, box) and fits(reference, box):
        run.log(f"{layer}: its coordinates fit {reference.horizontal} only; used as they are", "warning")
        return shape
    here, there = projection.parse(own.wkt), projection.parse(reference.wkt)
    if here is None or there is None:
        run.log(f"{layer} left out: no way from {own.horizontal} to {reference.horizontal}", "warning")
        return None
    run.log(f"{layer}: brought from {own.horizontal} to {reference.horizontal}")
    return shape.withColumn("g", geometry.moved(F.col("g"), projection.between(here, there)))


@check("quality", "Line connectivity", 40)
def connectivity(run: Run) -> None:
    lines, points = ([n for n in spatial(run, k) if not NETWORK_EXCLUDE.search(n)] for k in ("line", "point"))
    if not lines:
        return
    found = systems(run)
    main = dominant({n: found[n] for n in lines if n in found})
    reference = next((s for s in found.values() if s.horizontal == main), None) if main else None
    unit = (reference.unit_m if reference is not None else None) or 1.0
    table = run.dataset.catalog.get("definitions")
    own = [r.xy_tolerance for r in table.collect() if r.xy_tolerance and r["class"].lower() in {n.lower() for n in lines}] if table is not None and "xy_tolerance" in table.columns else []
    snap, near = max(own) if own else run.rules["thresholds"]["snap_tolerance_m"] / unit, run.rules["thresholds"]["near_miss_m"] / unit
    shape = {n: s for n in [*lines, *points] if (s := aligned(run, n, reference)) is not None}
    owner = lambda n: F.concat(F.lit(f"{n}:"), F.col("id").cast("string")).alias("owner")
    parts = [
        s.select(F.lit(n).alias("layer"), owner(n), F.explode(geometry.rings(F.col("g"))).alias("r")).where(F.size("r") > 1)
        for n, s in shape.items() if n in lines
    ]
    if not parts:
        return
    ring = trust.union(*parts)
    v = lambda k: F.element_at("r", k)
    ends = F.when(F.col("pos") == 0, F.array(*[F.struct(v(k).x.alias("x"), v(k).y.alias("y")) for k in (1, -1)])).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    pieces = ring.select("layer", "owner", "r", F.posexplode(F.zip_with(F.slice("r", F.lit(1), F.size("r") - 1), F.slice("r", F.lit(2), F.size("r") - 1), lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")))).alias("pos", "s"))
    pieces = pieces.select("layer", "owner", "s.*", ends.alias("ends"))
    spots = [s.select(owner(n), F.explode(geometry.vertices(F.col("g"))).alias("v")).select("owner", F.col("v.x").alias("x"), F.col("v.y").alias("y")) for n, s in shape.items() if n in points]
    states = network.endpoint_states(pieces, trust.union(*spots) if spots else None, snap, near)
    states = kept(states)  # the distance join runs once; all below reads its rows
    run.tables["endpoints"], run.tables["connectivity"] = states, network.connectivity(states)
    facts = run.tables["connectivity"].orderBy("layer").collect()
    short = F.element_at(F.split("owner", ":", 2), 2)
    loose = states.where("state <> 'connected'").withColumn("id", short)
    ids = {(r.layer, r.state): r.ids for r in uniqueness.first_ids(loose, ["layer", "state"], "id", run.rules["thresholds"]["max_sample_ids"]).collect()} if any(r.near_miss or r.dangles for r in facts) else {}
    for r in facts:
        mine = loose.where(F.col("layer") == r.layer)
        for k, state, severity, words in ((r.near_miss, "near miss", "warning", "{} line ends stop short of another feature"), (r.dangles, "dangle", "info", "{} line ends touch nothing")):
            if k:
                these = mine.where(F.col("state") == state)
                run.find(severity, words.format(k), r.layer, k, ids.get((r.layer, state), ""), threshold=f"{snap:g}, {near:g}")
                run.flag(r.layer, these.select("id", geometry.point(F.col("x"), F.col("y")).alias("g")), severity, state, 250 if state == "near miss" else 120)
    n = sum(r.endpoints for r in facts)
    missed, free = sum(r.near_miss for r in facts), sum(r.dangles for r in facts)
    run.score(100.0 * (1 - min(1.0, (5 * missed + 0.5 * free) / n)) if n else None, 2)
    for name in (p for p in points if JUNCTION_HINT.search(p) and p in shape):
        first = F.element_at(geometry.vertices(F.col("g")), 1)
        spot = shape[name].select("id", F.lit(name).alias("owner"), first.x.alias("x"), first.y.alias("y"))
        lone = kept(network.orphan_points(spot, pieces.select("owner", "x1", "y1", "x2", "y2"), snap))
        k = lone.count()
        if k:
            run.find("warning", f"{k} points are orphan junctions, on no line", name, k, run.ids(lone, "id"), check="Orphan junctions", action="Move the point to its line, or remove it.")
            run.flag(name, lone.select("id", geometry.point(F.col("x"), F.col("y")).alias("g")), "warning", "orphan junction", 120)


@check("quality", "Z and M", 50)
def heights(run: Run) -> None:
    mine, table = spatial(run), run.dataset.catalog.get("definitions")
    if not mine:
        return
    told = {r["class"].lower(): r for r in table.collect()} if table is not None else {}
    has = {n: (bool(told[n.lower()].has_z) if n.lower() in told and told[n.lower()].has_z is not None else "z" in run.dataset.geometry[n].lower().split()[1:]) for n in mine}
    measured = {n: told[n.lower()].has_m for n in mine if n.lower() in told and told[n.lower()].has_m is not None}
    score = 100.0
    if len(set(has.values())) > 1:
        flat = [n for n in mine if not has[n]]
        run.find("warning", f"{len(flat)} of {len(mine)} layers have no heights, others do", count=len(flat), detail=_names(flat))
        score -= 25
    if len(set(measured.values())) > 1:
        bare = [n for n, m in measured.items() if not m]
        run.find("info", f"{len(bare)} layers have no measures, others do", count=len(bare), detail=_names(bare))
        score -= 10
    parts = [shapes(run, n).select(F.lit(n).alias("layer"), F.explode(geometry.vertices(F.col("g"))).alias("v")) for n in mine if has[n]]
    if parts:
        level = network.z_statistics(trust.union(*parts), F.col("v.z"), "layer")
        run.tables["heights"] = level
        known = {r.layer: r for r in level.collect()}
        flat = [n for n in mine if has[n] and (n not in known or known[n].flat)]
        if flat:
            run.find("warning", f"{len(flat)} layers with heights hold zeros only", count=sum(run.rows(n) for n in flat), detail=_names(flat))
            score -= min(30, 5 * len(flat))
    run.score(score, 0.5)


@check("quality", "Connection status", 70)
def isconnected(run: Run) -> None:
    """Rows whose ISCONNECTED holds a code that means "not connected"; 2 where no labels say otherwise."""
    table, bad, total = run.dataset.catalog.get("isconnected_codes"), 0, 0
    for n, df in run.layers().items():
        field = run.fields(df).get("isconnected")
        if n not in run.dataset.geometry or field is None:
            continue
        codes = [r.code for r in table.where((F.lower("layer") == n.lower()) & F.col("label").rlike(NOT_CONNECTED)).collect()] if table is not None else []
        off = number(F.col(field).cast("string")).isin([float(c) for c in codes or [2]])
        k = df.agg(F.count_if(off).alias("k")).head().k
        bad, total = bad + k, total + run.rows(n)
        if k:
            run.find("warning", f"{k} rows are marked as not connected", n, k, run.ids(df.where(off), df.columns[0]))
    run.score(scoring.penalty_of(bad, total, 3.0) if total else None)


@check("quality", "System tables", 85)
def system_tables(run: Run) -> None:
    """A network's own tables: rules, subnetworks, dirty areas, errors, associations."""
    names = {r.layer.upper(): r for r in run.inventory()}
    first = next((n for n in sorted(names) if re.fullmatch(r"UN_\d+_ASSOCIATIONS", n)), None)
    package = any(n in names for n in ("C_ASSOCIATIONS", "C_SUBNETWORKCONTROLLERS"))
    if first is None and not package:
        return
    keys = [(df, run.fields(df)["globalid"]) for df in run.layers().values() if "globalid" in run.fields(df)]
    score, prefix = 100.0, first.rpartition("_")[0] if first else None
    count = lambda t: names[t].rows if t in names else None
    if prefix:
        for t, severity, words, less in (("RULES", "error", "The network has no rules", 40), ("SUBNETWORKS", "warning", "No subnetworks exist", 15)):
            if not count(f"{prefix}_{t}"):
                run.find(severity, words, f"{prefix}_{t}")
                score -= less
        if dirty := count(f"{prefix}_DIRTYAREAS"):
            run.find("warning", f"{dirty} dirty areas: the topology must be validated", f"{prefix}_DIRTYAREAS", dirty)
            score -= 20
        if errors := sum(count(f"{prefix}_{t}") or 0 for t in ("POINTERRORS", "LINEERRORS", "POLYGONERRORS")):
            run.find("error", f"{errors} topology errors are recorded", count=errors)
            score -= 30
        sub = run.dataset.layer(f"{prefix}_SUBNETWORKS")
        if sub is not None and "isdirty" in run.fields(sub) and count(f"{prefix}_SUBNETWORKS"):
            n = sub.agg(F.count_if(number(F.col(run.fields(sub)["isdirty"]).cast("string")) == 1).alias("n")).head().n
            if n:
                run.find("warning", f"{n} of {names[f'{prefix}_SUBNETWORKS'].rows} subnetworks are dirty", f"{prefix}_SUBNETWORKS", n)
                score -= min(20, 100 * n / names[f"{prefix}_SUBNETWORKS"].rows)
        junctions = run.dataset.layer(f"{prefix}_SYSTEMJUNCTIONS")
        if junctions is not None and "globalid" in run.fields(junctions):
            keys.append((junctions, run.fields(junctions)["globalid"]))
        ends = [(first, ("fromglobalid", "toglobalid"), "error", 300)]
    else:
        if count("B_RULES") == 0:
            run.find("error", "The asset package has no rules", "B_Rules")
            score -= 40
        ends = [("C_ASSOCIATIONS", ("from_global_id", "to_global_id"), "warning", 100), ("C_SUBNETWORKCONTROLLERS", ("global_id",), "warning", 100)]
    for table, columns, severity, factor in ends:
        df = run.dataset.layer(table)
        have = [run.fields(df)[c] for c in columns if c in run.fields(df)] if df is not None else []
        if not have or not keys or not count(table) or prefix and len(have) < 2:
            continue
        lost = references.orphans(df, have, references.known_ids(*keys))
        n = lost.count()
        if n:
            run.find(severity, f"{n} rows refer to features that do not exist", names[table].layer, n, run.ids(lost, df.columns[0]))
            score -= min(30, factor * n / names[table].rows)
        if "associationtype" in run.fields(df):
            run.tables["association_types"] = df.groupBy(F.col(run.fields(df)["associationtype"]).cast("string").alias("type")).agg(F.count("*").alias("n"))
    run.tables["system_tables"] = run.dataset.spark.createDataFrame([(r.layer, r.rows) for r in run.inventory() if r.system], "table string, rows long")
    run.score(score)


# ---- report ---------------------------------------------------------------------------------------


@check("report", "Map preview", 10)
def map_preview(run: Run) -> None:
    """A sample of the three layers with most rows as context, and what the checks flagged, as GeoJSON features in degrees where the system is known."""
    largest = sorted(spatial(run), key=lambda n: (-run.rows(n), n))[:3]
    parts = [trust.hash_sample(shapes(run, n).select(F.lit(n).alias("layer"), F.col("id").cast("string").alias("id"), "g"), "layer", "id", 800).select("layer", "id", F.lit("context").alias("severity"), F.lit("").alias("label"), "g") for n in largest]
    found, features = systems(run), []
    for part in [*parts, *run.flags]:
        features.append(part)
    if not features:
        return
    ways: dict[projection.Projection, list[str]] = {}
    for n, s in found.items():
        if (way := projection.parse(s.wkt)) is not None and way.method:
            ways.setdefault(way, []).append(n)
    g = F.col("g")
    for way, names in ways.items():
        g = F.when(F.col("layer").isin(names), geometry.moved(F.col("g"), projection.between(way, projection.DEGREES))).otherwise(g)
    kinds = F.create_map(*[F.lit(x) for n, k in run.dataset.geometry.items() for x in (n, k)])[F.col("layer")]
    flagged = F.when(F.size(geometry.vertices(F.col("g"))) == 1, "point").otherwise(kinds)
    every = trust.union(*features).withColumn("g", g)
    run.tables["map"] = every.select("layer", "severity", geometry.geojson(flagged, F.col("g"), F.struct("layer", "id", "severity", "label")).alias("feature"))
    run.tables["legend"] = every.groupBy("layer", "severity", "label").agg(F.count("*").alias("features"))


@check("report", "Top issues", 20)
def top_issues(run: Run) -> None:
    """The eight findings that matter most: by severity, then by records; hints are left out."""
    table = run.dataset.spark.createDataFrame(run.findings, f"{trust.BASE}, {trust.MORE}")
    run.tables["top_issues"] = trust.ordered(trust.detailed(table)).where("severity <> 'info'").select("severity", "check", "layer", "message", "count").limit(8)
