"""Segmenting operators that DataFrame functions express: CSV, shell, Markdown, text, simple logs; bounds on chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, count_tokens, split_tokens, tokens

PROMPT = r"^(?:\$ |# |> |\w+@[\w.-]+[:~].*[$#] |PS [^>]*> )"


def lines_of(calls: DataFrame, key: str = "call_id", text: str = "raw_output") -> DataFrame:
    return calls.select(key, F.posexplode(F.split(text, r"\n")).alias("pos", "line"))


def chunked(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Adds id and token_count to rows (key, ord, content, ...)."""
    return df.withColumn("id", chunk_id(F.col(content))).withColumn("token_count", count_tokens(F.col(content)))


def prefilter(text: Column, head_tokens: int = 30_000) -> Column:
    """Head and tail of texts of more than twice ``head_tokens`` tokens, with a marker between."""
    toks = F.array(tokens(text))
    cut = F.transform(toks, lambda t: F.array_join(F.slice(t, F.lit(1), F.lit(head_tokens)), ""))
    head = F.element_at(cut, 1)
    return F.when((F.length(text) > 2 * head_tokens) & (count_tokens(text) > 2 * head_tokens), F.concat(head, F.lit("\n[... middle omitted ...]\n"), F.right(text, F.length(head)))).otherwise(text)


def csv_windows(lines: DataFrame, key: str, rows: int = 50) -> DataFrame:
    """(key, ord, start_row, end_row, content): tumbling windows of data rows under a repeated header; ``lines`` are (key, pos, line) with the header at 0."""
    head = lines.where("pos = 0").select(key, F.col("line").alias("header"))
    body = lines.where((F.col("pos") > 0) & (F.trim("line") != "")).withColumn("ord", F.floor((F.col("pos") - 1) / rows).cast("int"))
    parts = body.groupBy(key, "ord").agg(F.min("pos").alias("start_row"), F.max("pos").alias("end_row"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("rows"))
    return parts.join(head, key).select(key, "ord", "start_row", "end_row", F.concat("header", F.lit("\n"), "rows").alias("content"))


def csv_categories(lines: DataFrame, key: str, sample: int = 100) -> DataFrame:
    """(key, column, category, content): rows grouped by the first column with 2 to 20 distinct values in the first ``sample`` rows; short rows are dropped."""
    head = lines.where("pos = 0").select(key, F.col("line").alias("header"))
    body = lines.where("pos > 0").withColumn("cells", F.transform(F.split("line", ","), lambda c: F.trim(c)))
    cells = body.where(F.col("pos") <= sample).select(key, F.posexplode("cells").alias("column", "value"))
    pick = cells.groupBy(key, "column").agg(F.countDistinct("value").alias("n")).where("n between 2 and 20").groupBy(key).agg(F.min("column").alias("column"))
    rows = body.join(pick, key).where(F.size("cells") > F.col("column")).withColumn("category", F.get("cells", F.col("column")))
    parts = rows.groupBy(key, "column", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("rows"))
    return parts.join(head, key).select(key, "column", "category", F.concat("header", F.lit("\n"), "rows").alias("content"))


def islands(lines: DataFrame, key: str, label: str) -> DataFrame:
    """(key, island, label, first, last, content): runs of lines with equal labels; ``lines`` are (key, pos, line, label). Used for log levels and mixed formats."""
    w = Window.partitionBy(key).orderBy("pos")
    flag = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = lines.withColumn("flag", flag).withColumn("island", F.sum("flag").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island", label).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content"))


def shell_commands(lines: DataFrame, key: str) -> DataFrame:
    """(key, command, content): a prompt line and its output; commands without output, and lines before the first prompt, are dropped."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("command", F.sum(F.col("line").rlike(PROMPT).cast("int")).over(w)).where("command > 0")
    return numbered.groupBy(key, "command").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content")).where("n > 1").drop("n")


def paragraphs(text: Column, least_lines: int = 1) -> Column:
    return F.filter(F.split(text, "\n\n"), lambda p: (F.trim(p) != "") & (F.size(F.split(p, "\n")) >= least_lines))


def markdown_sections(lines: DataFrame, key: str) -> DataFrame:
    """(key, section, fenced, content): sections begin at headings outside fences; what stands before the first is section 0."""
    w = Window.partitionBy(key).orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    fenced = F.coalesce(F.sum(F.col("line").rlike(r"^\s*(?:```|~~~)").cast("int")).over(upto), F.lit(0)) % 2
    marked = lines.withColumn("fenced", fenced).withColumn("head", (F.col("line").rlike(r"^#{1,6} \S") & (F.col("fenced") == 0)).cast("int"))
    numbered = marked.withColumn("section", F.sum("head").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "section").agg(F.max("fenced").alias("fenced"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content"))


def pack(parts: Column, limit: int, joiner: str = "\n\n") -> Column:
    """Folds neighbouring parts together as long as a packet has at most ``limit`` tokens: small sections merge, large ones split."""
    zero = F.array().cast("array<struct<text:string,n:int>>")

    def step(acc: Column, p: Column) -> Column:
        n = count_tokens(p)
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (last["n"] + n <= limit)
        merged = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.concat(last["text"], F.lit(joiner), p).alias("text"), (last["n"] + n).alias("n"))))
        return F.when((F.size(acc) > 0) & F.coalesce(fits, F.lit(False)), merged).otherwise(F.concat(acc, F.array(F.struct(p.alias("text"), n.alias("n")))))

    return F.transform(F.aggregate(parts, zero, lambda a, p: F.when(F.size(a) == 0, F.array(F.struct(p.alias("text"), count_tokens(p).alias("n")))).otherwise(step(a, p))), lambda x: x["text"])


def dedup_first(chunks: DataFrame, key: str) -> DataFrame:
    """The first chunk of each id in a call."""
    w = Window.partitionBy(key, "id").orderBy("ord")
    return chunks.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def cap_chunks(chunks: DataFrame, key: str, most: int = 2000) -> DataFrame:
    """Calls with more than ``most`` chunks: groups of ceil(n / most) neighbours become one chunk; token counts add up, the first one's type stays."""
    total = chunks.groupBy(key).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("start_pos", "ord")
    ranked = chunks.join(total, key).withColumn("rn", F.row_number().over(w)).withColumn("ord", F.floor((F.col("rn") - 1) / F.ceil(F.col("n") / most)).cast("int"))
    return ranked.groupBy(key, "ord").agg(F.min_by("chunk_type", "rn").alias("chunk_type"), F.sum("token_count").alias("token_count"), F.min("start_pos").alias("start_pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "content"))), lambda x: x["content"]), "\n").alias("content"))


def split_oversized(chunks: DataFrame, budget: int) -> DataFrame:
    """If a chunk is over budget, it becomes windows of max(budget // 2, 200) tokens; blank ones are dropped; start_pos moves on by one for each."""
    window = max(budget // 2, 200)
    parts = F.when(F.col("token_count") > budget, F.filter(split_tokens(F.col("content"), window), lambda p: F.trim(p) != "")).otherwise(F.array("content"))
    out = chunks.select("*", F.posexplode(parts).alias("part", "piece"))
    return out.withColumn("content", F.col("piece")).withColumn("start_pos", F.col("start_pos") + F.col("part")).withColumn("token_count", count_tokens(F.col("piece"))).drop("piece")
