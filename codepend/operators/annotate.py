"""Program records as JSON and delimited text, prompts and parsed replies, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROGRAM = "program array<string>, periphery array<string>"


def program_json(programs: DataFrame) -> DataFrame:
    """(pid, json): genes, and periphery genes that aren't program genes."""
    return programs.select("pid", F.to_json(F.struct("program", F.array_except("periphery", "program").alias("periphery"))).alias("json"))


def program_genes(records: DataFrame) -> DataFrame:
    """(pid, place, gene) of the core genes in (pid, json)."""
    return records.select("pid", F.from_json("json", PROGRAM).alias("r")).select("pid", F.posexplode("r.program").alias("place", "gene"))


def loadings_json(loadings: DataFrame) -> DataFrame:
    """(pid, json): a map from gene to loading, in the order of genes."""
    pairs = F.sort_array(F.collect_list(F.struct("gene", "w")))
    return loadings.groupBy("pid").agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def reply_parts(reply: Column) -> dict[str, Column]:
    """Title, inconsistent genes and summary of a reply; without `Summary:` all of it is the summary."""
    at = F.instr(reply, "Summary:")
    return {
        "title": F.trim(F.regexp_extract(reply, r"(?m)^Title:[ \t]*(.*)$", 1)),
        "inconsistent": F.trim(F.regexp_extract(reply, r"(?m)^Inconsistent Genes:[ \t]*(.*)$", 1)),
        "summary": F.trim(F.when(at > 0, F.substr(reply, at + 8)).otherwise(reply)),
    }


def own_genes(listed: Column, genes: Column) -> Column:
    """The program's genes in a comma-separated list; NONE, in any case, gives none."""
    names = F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda x: (x != "") & F.array_contains(genes, x))
    return F.when(F.upper(F.trim(listed)) == "NONE", F.array().cast("array<string>")).otherwise(names)


def has_api_key(key: str | None) -> bool:
    """Whether a key is a real one and no placeholder."""
    return bool(key) and str(key).strip().startswith("sk-")


def filled(template: str, weights: Column, types: list[str] | None = None) -> Column:
    """A template with its fields {positively_loaded_genes}, {negatively_loaded_genes} and, where it has it, {cell_types} filled in, as lists of names."""
    listed = lambda names: F.concat(F.lit("["), F.array_join(F.transform(names, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    genes = lambda keep: listed(F.array_sort(F.map_keys(F.map_filter(weights, keep))))
    text = F.lit(template)
    for field, value in (("positively_loaded_genes", genes(lambda _, w: w > 0)), ("negatively_loaded_genes", genes(lambda _, w: w < 0)), ("cell_types", listed(F.array(*map(F.lit, types or []))))):
        text = F.replace(text, F.lit("{" + field + "}"), value)
    return text


def prompt(weights: Column, types: Column | None = None) -> Column:
    """The request for one program: genes of positive and of negative weight, by name, and cell types where given."""
    names = lambda keep: F.array_join(F.array_sort(F.map_keys(F.map_filter(weights, keep))), ", ")
    text = F.concat(F.lit("Positive genes: "), names(lambda _, w: w > 0), F.lit("\nNegative genes: "), names(lambda _, w: w < 0))
    return text if types is None else F.concat(text, F.lit("\nCell types: "), types)


def first_genes(genes: Column, n: int = 100) -> Column:
    """The first n names and how many more there are."""
    more = F.when(F.size(genes) > n, F.concat(F.lit(" … and "), (F.size(genes) - n).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(F.slice(genes, 1, n), ", "), more)


def empty_summaries(programs: DataFrame) -> DataFrame:
    """The rows of a summary table before anything is annotated."""
    blank = F.lit("")
    return programs.select(F.concat(F.lit("Program "), F.col("pid").cast("string")).alias("Program"), blank.alias("Title"), F.array_join("program", ", ").alias("Genes"), F.size("program").alias("Number of Genes"), blank.alias("Inconsistent Genes"), F.lit(0).alias("Number of Inconsistent Genes"), blank.alias("Summary"))


def summaries(loadings: DataFrame, ask, template: str | None = None, types: list[str] | None = None, concurrency: int = 3) -> DataFrame:
    """The summary table of all programs of (pid, gene, w): each asked for once, its reply parsed, foreign genes left out."""
    maps = loadings.groupBy("pid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("gene", "w")))).alias("w"))
    genes = F.array_sort(F.map_keys(F.map_filter("w", lambda _, w: w != 0)))
    text = prompt(F.col("w"), F.lit(", ".join(types)) if types else None) if template is None else filled(template, F.col("w"), types)
    asked = annotated(maps.select("pid", genes.alias("genes"), text.alias("prompt")), ask, concurrency)
    r = asked.withColumns(reply_parts(F.col("reply"))).withColumn("bad", own_genes(F.col("inconsistent"), F.col("genes")))
    columns = {"Program": F.concat(F.lit("Program "), F.col("pid").cast("string")), "Title": F.col("title"), "Genes": F.array_join("genes", ", "), "Number of Genes": F.size("genes"), "Inconsistent Genes": F.array_join("bad", ", "), "Number of Inconsistent Genes": F.size("bad"), "Summary": F.col("summary")}
    return r.select(*(c.alias(n) for n, c in columns.items()))


def csv_text(rows: DataFrame) -> str:
    """All rows, one for each program, as text between dollar signs, every field quoted, after a byte order mark."""
    quoted = lambda values: "$".join('"' + str(v).replace('"', '""') + '"' for v in values)
    number = F.expr("try_cast(regexp_extract(Program, '([0-9]+)$', 1) as int)")
    body = rows.orderBy(number, "Program").toLocalIterator()
    return "\ufeff" + "\n".join([quoted(rows.columns), *(quoted(r) for r in body)])


def write_summaries(rows: DataFrame, path: str) -> None:
    """The table with genes under path/with_genes, and without them under path/no_genes; a program a row."""
    for name, drop in (("with_genes", ()), ("no_genes", ("Genes", "Inconsistent Genes"))):
        text = csv_text(rows.drop(*drop))
        rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def read_summaries(spark, path: str) -> DataFrame:
    """Summaries with the program's number as pid. The program's column is the first whose name holds `program`, in any case."""
    df = spark.read.csv(path, sep="$", header=True, quote='"', escape='"', multiLine=True)
    df = df.withColumnsRenamed({c: c.strip('\ufeff"') for c in df.columns})
    key = next(c for c in df.columns if "program" in c.lower())
    return df.withColumn("pid", F.regexp_replace(key, "^\ufeff?Program ", "").cast("int"))


def overview(programs: DataFrame, summaries: DataFrame) -> DataFrame:
    """(pid, title, n_genes, n_inconsistent) of all programs and, last, their totals; programs without a summary have blanks and 0."""
    s = summaries.select("pid", F.col("title").alias("t"), F.expr("try_cast(n_bad as bigint)").alias("b"))
    rows = programs.join(s, "pid", "left").select(F.col("pid").cast("string").alias("pid"), F.coalesce("t", F.lit("")).alias("title"), F.size("program").cast("long").alias("n_genes"), F.coalesce("b", F.lit(0)).cast("long").alias("n_inconsistent"))
    return rows.union(rows.agg(F.lit("total"), F.lit(""), F.sum("n_genes"), F.sum("n_inconsistent")))


def annotated(programs: DataFrame, ask, concurrency: int = 3) -> DataFrame:
    """programs (with `prompt`) and `reply` from the callable ask(prompt), which is given by the user; a few tasks call it at a time."""

    def work(batches):
        for b in batches:
            b["reply"] = [ask(p) for p in b["prompt"]]
            yield b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in programs.schema)
    return programs.repartition(concurrency).mapInPandas(work, f"{schema}, reply string")


def markdown(rows: DataFrame) -> str:
    """A table of report rows, which are as many as programs."""
    head = f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}"
    return "\n".join([head, *(f"| {' | '.join(map(str, r))} |" for r in rows.toLocalIterator())]) + "\n"


def report(programs: DataFrame, rows: DataFrame, info: dict, activity: DataFrame | None = None) -> str:
    """The whole report as Markdown: facts of the data, the overview, and a page for each program; programs are few.

    programs: (pid, program); rows: read_summaries(); activity: quartiles (pid, cluster, q1, med, q3) for the pages.
    """
    found = {r["pid"]: r.asDict() for r in rows.toLocalIterator()}
    listed = sorted(((r["pid"], r["program"]) for r in programs.select("pid", "program").toLocalIterator()))
    sizes = sorted((len(g) for _, g in listed), reverse=True)
    boxes: dict[int, list] = {}
    for r in activity.orderBy("pid", "cluster").toLocalIterator() if activity is not None else ():
        boxes.setdefault(r["pid"], []).append(f"| {r['cluster']} | {r['q1']:.4g} | {r['med']:.4g} | {r['q3']:.4g} |")
    out = ["# Gene Program Analysis Report", "## Dataset Information", *(f"{k}: {v}" for k, v in info.items()), "## Program Summary", f"Number of Programs Found: {len(listed)}", f"Number of Unique Genes Covered: {len(set().union(*(g for _, g in listed)))}", f"Program Size Distribution: {sizes}", "## Programs Overview"]
    short = rows.select("pid", F.col("Title").alias("title"), F.col("Number of Inconsistent Genes").alias("n_bad"))
    out.append(markdown(overview(programs, short)))
    for pid, genes in listed:
        row = found.get(pid, {})
        title, text = (row.get("Title") or "").strip(), (row.get("Summary") or "").strip()
        out.append(f"## Program {pid}{': ' + title if title else ''} ({len(genes)} genes)")
        out.append(f"Program Description: {text or 'No description available.'}")
        if pid in boxes:
            out += ["Program Activity Across Clusters:", "\n".join(["| cluster | q1 | median | q3 |", "|---|---|---|---|", *boxes[pid]])]
        more = f" ... and {len(genes) - 100} more genes" if len(genes) > 100 else ""
        out.append("Program Genes (First 100): " + ", ".join(genes[:100]) + more)
    return "\n\n".join(out) + "\n"
