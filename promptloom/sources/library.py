"""Sources and sinks around prompts: template files, front matter, saved prompts, catalogues, event streams, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def templates(spark: SparkSession, pattern: str) -> DataFrame:
    """Whole files of a glob: path, raw."""
    return spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))


def front_matter(df: DataFrame) -> DataFrame:
    """Split ``raw`` into ``meta`` (map; a key ends at the first colon, values keep later ones) and ``body``; without front matter all is body."""
    found = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
    head = F.regexp_extract("raw", found, 1)
    pairs = F.expr(r"filter(split(_head, '\\r?\\n'), x -> instr(x, ':') > 0)")
    entry = F.expr(r"map_from_entries(transform(_pairs, x -> struct(trim(substring_index(x, ':', 1)) as k, trim(substring(x, instr(x, ':') + 1)) as v)))")
    df = df.withColumn("_has", F.col("raw").rlike(found)).withColumn("_head", head).withColumn("_pairs", pairs)
    distinct = F.expr(r"filter(_pairs, (x, i) -> not exists(slice(_pairs, i + 2, size(_pairs)), y -> trim(substring_index(y, ':', 1)) = trim(substring_index(x, ':', 1))))")
    df = df.withColumn("_pairs", distinct).withColumn("meta", F.when(F.col("_has"), entry).otherwise(F.expr("cast(map() as map<string,string>)")))
    return df.withColumn("body", F.when(F.col("_has"), F.regexp_extract("raw", found, 2)).otherwise(F.col("raw"))).drop("_has", "_head", "_pairs")


def front_matter_by_parts(df: DataFrame) -> DataFrame:
    """The other reading: split at '---' lines, drop empty parts, the first is the head; a value ends at a second ': '."""
    df = df.withColumn("_parts", F.expr(r"filter(split(raw, '---\\n'), x -> x <> '')"))
    lines = r"filter(split(get(_parts, 0), '\\n'), x -> size(split(x, ': ')) > 1)"
    df = df.withColumn("_pairs", F.expr(f"transform({lines}, x -> struct(trim(get(split(x, ': '), 0)) as k, trim(get(split(x, ': '), 1)) as v))"))
    last = "filter(_pairs, (x, i) -> not exists(slice(_pairs, i + 2, size(_pairs)), y -> y.k = x.k))"  # of a key that repeats the last holds
    df = df.withColumn("meta", F.expr(f"map_from_entries({last})")).drop("_pairs")
    return df.withColumn("body", F.expr(r"trim(array_join(slice(_parts, 2, greatest(1, size(_parts))), '---\\n'))")).drop("_parts")


def title(name: Column) -> Column:
    """A file name as a title: team prefix off, words upper-cased at their first letter only."""
    bare = F.regexp_replace(F.regexp_replace(name, r"^(?:redteam|blueteam)-", ""), "-", " ")
    return F.array_join(F.transform(F.split(bare, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def team(name: Column) -> Column:
    """Whose template a file is, by its name: red, blue or framework."""
    return F.when(name.startswith("redteam-"), "red").when(name.startswith("blueteam-"), "blue").otherwise("framework")


def verdicts(templates_: DataFrame) -> DataFrame:
    """The firewall on every red and blue template (name, body), by title: red ones should be caught, blue ones allowed."""
    from ..operators import firewall

    df = templates_.withColumn("team", team(F.col("name"))).where("team <> 'framework'")
    df = firewall.assess(df.withColumnRenamed("body", "text")).withColumn("title", title(F.col("name")))
    as_wanted = (F.col("decision") != "allow") == (F.col("team") == "red")
    return by_title(df.select("name", "title", "team", "decision", as_wanted.alias("as_wanted")), "name")


#: The order of titles for a reader: letters before case and accents, as the root collation has it.
LOCALE = "UNICODE"


def locale(name: str = "title") -> Column:
    """A column of text that sorts as a reader expects."""
    return F.collate(F.col(name), LOCALE)


def by_title(df: DataFrame, *then: str) -> DataFrame:
    """Templates in the order of their titles."""
    return df.orderBy(locale(), *then)


def model_catalogue(df: DataFrame) -> DataFrame:
    """Defaults for a model list: context length 4096, prices per thousand tokens, 0 where they don't parse."""
    price = lambda c: F.coalesce(F.expr(f"try_cast(pricing.{c} as double)") * 1000, F.lit(0.0))
    return df.select("id", F.coalesce("name", "id").alias("name"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("context_length", F.lit(4096)).cast("long").alias("context_length"), price("prompt").alias("prompt_usd"), price("completion").alias("completion_usd"))


def sse_text(payload: str = "payload") -> Column:
    """The text of an event stream: the deltas of its data lines in order; blank, [DONE], other and malformed lines are passed over."""
    data = f"filter(transform(split({payload}, '\\\\r?\\\\n'), x -> trim(x)), x -> startswith(x, 'data:') and trim(substring(x, 6)) <> '[DONE]')"
    return F.expr(f"array_join(transform({data}, x -> coalesce(get_json_object(trim(substring(x, 6)), '$.choices[0].delta.content'), '')), '')")


def assemble(domain: str, category: str, output_type: str, overview: str, content: str) -> Column:
    """The labelled parts of a prompt, blank lines between."""
    parts = (("Domain", domain), ("Category", category), ("Output Type", output_type), ("Overview", overview))
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"{n}: "), F.col(c)) for n, c in parts), F.col(content))


def export_markdown(title_: str = "title", content: str = "content") -> Column:
    return F.concat(F.lit("# "), F.col(title_), F.lit("\n\n"), F.col(content))


def export_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"pretty": "true"})


def export_toml(*columns: str) -> Column:
    """Keys with quoted values; quotes within aren't escaped."""
    return F.concat_ws("\n", *(F.concat(F.lit(f'{c} = "'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in columns))


def save(df: DataFrame, path: str) -> None:
    """Append to a table of saved prompts."""
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Write the whole table of saved prompts anew, aside first, so ``df`` may read it; with writers at the same time use ``tablelog.SavedPrompts``."""
    spark, aside = df.sparkSession, f"{path.rstrip('/')}.new"
    df.write.mode("overwrite").parquet(aside)
    old, new = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, aside))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    fs.rename(new, old)
    spark.catalog.refreshByPath(path)


def without(saved: DataFrame, gone: str) -> DataFrame:
    """Saved prompts but the one with this id."""
    return saved.where(~F.col("id").eqNullSafe(F.lit(gone)))


def write_artefact(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
