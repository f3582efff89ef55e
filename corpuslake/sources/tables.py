"""Tables of the library: catalogue, landing folders, results, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings, steady_unions
from ..functions.text import collapse, file_name, paper_id, some
from ..operators.service import DownloadError, PaperNotFound

PAPER = T.StructType([
    T.StructField("paper_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("abstract", T.StringType()), T.StructField("published", T.DateType()), T.StructField("updated", T.DateType()),
    T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("pdf_url", T.StringType()), T.StructField("abs_url", T.StringType()), T.StructField("doi", T.StringType()),
])


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def map_results(results: DataFrame) -> DataFrame:
    """Search results (entry_id, title, authors, summary, published, updated, categories, pdf_url, doi) as papers.

    Ids lose their version, texts their extra white space, times their hours; an empty doi is null.
    """
    pid = F.coalesce(paper_id(F.col("entry_id")), F.regexp_replace(F.substring_index("entry_id", "/abs/", -1), r"v\d+$", ""))
    pdf = F.coalesce(some(F.col("pdf_url")), F.concat(F.lit("https://arxiv.org/pdf/"), pid))
    return results.select(
        pid.alias("paper_id"), collapse(F.col("title")).alias("title"), "authors", collapse(F.col("summary")).alias("abstract"), F.to_date("published").alias("published"),
        F.to_date("updated").alias("updated"), "categories", pdf.alias("pdf_url"), F.col("entry_id").alias("abs_url"), some(F.col("doi")).alias("doi"))


def lookup(papers: DataFrame, requests: DataFrame) -> DataFrame:
    """(request columns, paper, error) of each request (paper_id): a message where no paper has the id."""
    found = papers.select("paper_id", F.struct(*papers.columns).alias("paper"))
    missing = F.concat(F.lit("No paper has the ID "), F.col("paper_id"), F.lit("."))
    return requests.join(found, "paper_id", "left").withColumn("error", F.when(F.col("paper").isNull(), missing))


def find(papers: DataFrame, paper: str) -> Row:
    """One paper of the catalogue; PaperNotFound if no paper has the id."""
    found = papers.where(F.col("paper_id") == paper).limit(1).collect()
    if not found:
        raise PaperNotFound(f"no paper {paper}", user_message=f"No paper has the ID {paper}.")
    return found[0]


def file_error(length: Column, content: Column, settings: Settings = Settings()) -> Column:
    """Why bytes aren't a paper's file; null if they are."""
    return F.when(length > settings.max_file_mb << 20, F.lit(f"The file is larger than {settings.max_file_mb} MB.")).when(F.coalesce(F.substring(content, 1, 4) != F.lit(b"%PDF"), F.lit(True)), "The file isn't a PDF.")


def landed_files(spark: SparkSession, folder: str, settings: Settings = Settings()) -> DataFrame:
    """(path, length, content, valid, error) of the PDF files in a landing folder.

    Files over the size limit and those that aren't PDFs are rows with an error; of too large
    ones the content isn't read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    most = settings.max_file_mb << 20
    fits = files.where(F.col("length") <= most).select("path", "length", "content")
    large = files.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"))
    steady_unions(spark)
    whole = fits.unionByName(large).withColumn("error", file_error(F.col("length"), F.col("content"), settings))
    return whole.select("path", "length", "content", F.col("error").isNull().alias("valid"), "error")


def fetch_files(papers: DataFrame, landed: DataFrame, get_fn: Callable[[str], Iterable[bytes]], settings: Settings = Settings()) -> DataFrame:
    """(paper_id, content, error) of the papers (paper_id, pdf_url) that ``landed`` (paper_id) lacks.

    ``get_fn`` runs in the workers and gives a file's bytes in parts; reading ends as soon as
    they pass the size limit.  What fails is a row with an error.  Append the rows without an
    error to the landed table: a write of a table is seen whole or not at all.
    """
    most = settings.max_file_mb << 20

    def read(url: str) -> bytes:
        whole = bytearray()
        for part in get_fn(url):
            whole += part
            if len(whole) > most:
                raise DownloadError("too large", user_message=f"The file is larger than {settings.max_file_mb} MB.")
        if whole[:4] != b"%PDF":
            raise DownloadError("no PDF", user_message="The file isn't a PDF.")
        return bytes(whole)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for paper, url in zip(frame["paper_id"], frame["pdf_url"]):
                try:
                    row = (paper, read(url), None)
                except DownloadError as e:
                    row = (paper, None, e.user_message)
                except Exception as e:
                    row = (paper, None, f"The file couldn't be fetched: {e}")
                yield pd.DataFrame([row], columns=["paper_id", "content", "error"])

    wanted = papers.select("paper_id", "pdf_url").join(landed.select("paper_id"), "paper_id", "left_anti")
    return wanted.mapInPandas(run, "paper_id string, content binary, error string")


def with_file_names(papers: DataFrame) -> DataFrame:
    return papers.withColumn("file_name", file_name(F.col("paper_id")))


def folder_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(files, bytes) of a folder's files, from their metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def save_briefings(rendered: DataFrame, folder: str) -> None:
    """Write (paper_id, markdown, json) as one table, which holds any number of papers; ``export_briefings`` makes files of it."""
    rendered.select("paper_id", "markdown", "json").write.mode("overwrite").parquet(folder)


def export_briefings(rendered: DataFrame, folder: str) -> None:
    """Write columns markdown and json of each paper below ``folder``, a folder a paper; for few papers, to be read by people."""
    safe = F.replace(F.col("paper_id"), F.lit("/"), F.lit("_"))
    for kind in ("markdown", "json"):
        rendered.select(safe.alias("paper"), F.col(kind).alias("value")).write.mode("overwrite").partitionBy("paper").text(f"{folder}/{kind}")


def append_checkpoint(states: DataFrame, folder: str) -> None:
    states.write.mode("append").parquet(folder)


def evict(spark: SparkSession, folder: str, partition: str | None = None) -> bool:
    """Remove one partition of a cache folder (``column=value``), or the whole cache; false if it wasn't there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{partition}" if partition else folder)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


#: Characters of phrases that meet the papers in one scan.
PHRASE_CHARS = 4 << 20


def scratch(spark: SparkSession) -> str:
    """A new folder for a job's tables, in the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpuslake-")
    return f"{base.rstrip('/')}/corpuslake/job-{uuid.uuid4().hex}"


def kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table that several steps read, and read it back."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _phrase_blocks(phrases: DataFrame) -> Iterator[list[str]]:
    block, size = [], 0
    for (p,) in phrases.toLocalIterator():
        block.append(p)
        size += len(p)
        if size >= PHRASE_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_phrases(texts: DataFrame, phrases: DataFrame, *, id_col: str = "paper_id", text_col: str = "text") -> DataFrame:
    """(id, phrase, n): which distinct phrases (phrase) each text contains, and how often, counted without overlaps.

    All phrases of a block are found in one pass over a text; a block more is a scan more.
    Empty phrases are in no text.
    """
    spark = texts.sparkSession
    base = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    kind = base.schema["id"].dataType.simpleString()
    out = None
    for own in _phrase_blocks(phrases.select("phrase").where("phrase <> ''").distinct()):
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, p in enumerate(shared.value):
                automaton.add_word(p, i)
            automaton.make_automaton()
            sizes = list(map(len, shared.value))
            for batch in batches:
                at, phrase, times = [], [], []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    found: dict[int, list[int]] = {}
                    for end, i in automaton.iter(text):
                        seen = found.setdefault(i, [0, -1])
                        if end - sizes[i] >= seen[1]:
                            seen[0] += 1
                            seen[1] = end
                    at += [row] * len(found)
                    phrase += [shared.value[i] for i in found]
                    times += [n for n, _ in found.values()]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array(phrase, pa.string()), pa.array(times, pa.int64())], ["id", "phrase", "n"])

        part = base.mapInArrow(run, f"id {kind}, phrase string, n long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"id {kind}, phrase string, n long")
    return out.withColumnRenamed("id", id_col)


def search_catalogue(papers: DataFrame, queries: DataFrame, max_results: int = 20) -> DataFrame:
    """(query_id, paper_id, score, rank): the papers that contain all phrases of a boolean query.

    ``queries`` has query_id and terms (array), in any number; the phrases, not the papers, are
    read when the plan is made.  More frequent phrases rank higher, then smaller ids.  Empty
    phrases don't count; a query without any other finds nothing.
    """
    asked = queries.select("query_id", F.array_distinct(F.filter("terms", lambda t: t != "")).alias("terms"))
    # a phrase that a query repeats counts as often
    times = queries.select("query_id", F.explode("terms").alias("phrase")).where("phrase <> ''").groupBy("query_id", "phrase").agg(F.count("*").alias("times"))
    wanted = times.join(asked.select("query_id", F.size("terms").alias("n_terms")), "query_id")
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    steady_unions(papers.sparkSession)
    met = find_phrases(papers.select("paper_id", text.alias("text")), wanted.select("phrase"))
    scored = met.join(wanted, "phrase").groupBy("query_id", "paper_id", "n_terms").agg(F.count("*").alias("found"), F.sum(F.col("n") * F.col("times")).alias("score"))
    hits = scored.where("found = n_terms").select("query_id", "paper_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "paper_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= max_results)
