"""WARC archives: written and read back with Spark's text source, checked by boundary chains.

Reading splits files at every "WARC/1.1\\r\\n", wherever it stands; each piece is a candidate record, whose
Content-Length gives the offset of its successor. Runs of candidates that follow one another are joined, and
pointer jumping over the runs from offset 0 keeps those that are reachable, so magic inside a payload is payload.
Windows and joins see offsets alone; only the pieces of records that hold magic are gathered with their payload.
A chain that ends elsewhere than at the end of its file is an error, or with on_defect="skip" the rest of that file is left out.
Files are gzip as a whole. Null payloads are empty; payloads are UTF-8 of any length; equal pages are each a record, with one
record id; a null page_id is written as "null" and read as null; extra columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.sources.tables import Scratch, no_shuffles_left, written

MAGIC, CRLF, END = "WARC/1.1\r\n", "\r\n", "\r\n\r\n"
MIN_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id, digest):
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest).cast("binary"))
    return F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """A record per page; of equal payloads of at least MIN_REVISIT bytes the largest page_id is the response. `date` is WARC-Date, as pages have no time."""
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    with Scratch(pages.sparkSession, "warc-write") as tmp, no_shuffles_left(pages.sparkSession):
        # one small row per group that has copies; the same kind of join at every size
        groups = tmp.written(p.where(f"n >= {MIN_REVISIT}").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k"), "revisits")
        p = p.join(groups.hint("merge"), "digest", "left")
        revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
        http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{END}"), F.col("html"))
        p = p.withColumn("is_revisit", revisit).withColumn("block", F.when(revisit, F.lit("")).otherwise(http))
        refers = F.concat(
            F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), _record_id(F.col("first"), F.col("digest")),
            F.lit(f"{CRLF}X-Refers-To-Page: "), F.col("first").cast("string"),
        )
        head = F.concat(
            F.lit(MAGIC + "WARC-Type: "), F.when(F.col("is_revisit"), "revisit").otherwise("response"),
            F.lit(f"{CRLF}WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest")),
            F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", ""),
            F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"),
            F.lit(f"{CRLF}X-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")),
            F.lit(f"{CRLF}X-Payload-Length: "), F.col("n").cast("string"),
            F.when(F.col("is_revisit"), refers).otherwise(""),
            F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length("block").cast("string"), F.lit(END),
        )
        out = p.select(F.concat(head, "block").alias("value"))
        out.write.option("lineSep", END).option("maxRecordsPerFile", 50_000).option("compression", "gzip").text(path)


def _reachable(c: DataFrame, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pieces (f, split, i, at, n, jump) -> the same with their run, and the runs (f, split, run) that a chain from offset 0 reaches, with a flag on chains that break."""
    far = c.where("jump is not null and jump <> n").select("f", (F.col("at") + F.col("jump")).alias("at"), F.lit(1).alias("hit")).distinct()
    w = Window.partitionBy("f", "split").orderBy("i")
    follows = F.coalesce(F.lag(F.coalesce(F.col("jump") == F.col("n"), F.lit(False))).over(w), F.lit(False))
    c = c.withColumn("follows", follows).join(far, ["f", "at"], "left")
    c = tmp.written(c.withColumn("run", F.sum((~F.col("follows") | F.col("hit").isNotNull()).cast("long")).over(w)).drop("follows", "hit"), "runs")
    ends = c.groupBy("f").agg(F.max(F.col("at") + F.col("n")).alias("end"))
    first = tmp.written(c.groupBy("f", "split", "run").agg(F.min("at").alias("a"), F.max_by(F.col("at") + F.col("jump"), "at").alias("jump")), "run-graph")
    runs, old, reach = first.select("f", "a", "jump"), None, first.where("a = 0").select("f", "a")
    known, last = reach.count(), None
    while True:  # reach doubles its steps each round: all that one jump of 2^k steps leads to is added
        grown = tmp.written(reach.union(reach.join(runs, ["f", "a"]).select("f", F.col("jump").alias("a"))).join(first.select("f", "a"), ["f", "a"], "left_semi").distinct(), "reach")
        n = grown.count()
        if last is not None:
            tmp.drop(last)
        reach = last = grown
        if n == known:
            break
        known = n
        twice = runs.join(runs.select("f", F.col("a").alias("jump"), F.col("jump").alias("jump2")), ["f", "jump"], "left")
        doubled = tmp.written(twice.select("f", "a", F.coalesce("jump2", "jump").alias("jump")), "jumps")
        if old is not None:
            tmp.drop(old)
        runs = old = doubled
    ok = first.join(reach, ["f", "a"], "left_semi")
    starts = first.select("f", F.col("a").alias("jump"), F.lit(True).alias("there"))
    ok = ok.join(starts, ["f", "jump"], "left").join(ends, "f").withColumn("breaks", F.col("there").isNull() & ~F.col("jump").eqNullSafe(F.col("end")))
    return c, tmp.written(ok.select("f", "split", "run", "breaks"), "reached")


def read(spark: SparkSession, path: str, on_defect: str = "raise") -> DataFrame:
    """(file, head, block) of each reachable record."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("i"))
    # the length of every piece, with the mark that ended it; a file starts with the mark, so its first piece is empty
    head = F.substring_index("value", END, 1)
    length = F.regexp_extract(head, r"(?i)(?:^|\r\n)content-length:[ \t]*(\d{1,18})(?:\r\n|$)", 1)
    jump = F.when((length != "") & (F.octet_length(head) < F.octet_length("value")), len(MAGIC) + F.octet_length(head) + 4 + length.cast("long") + 4)
    pieces = written(raw.withColumn("f", F.xxhash64("file")).withColumn("n", F.octet_length("value").cast("long") + len(MAGIC)).withColumn("jump", jump), "pieces")
    with Scratch(spark, "warc-read") as tmp:
        small = pieces.select("f", "split", "i", "n", "jump")
        s = small.groupBy("f", "split").agg(F.sum("n").alias("s"))
        before = s.select("f", "split", (F.sum("s").over(Window.partitionBy("f").orderBy("split")) - F.col("s")).alias("before"))
        own = small.withColumn("own", F.sum("n").over(Window.partitionBy("f", "split").orderBy("i")) - F.col("n"))
        at = own.join(before, ["f", "split"]).withColumn("at", F.col("before") + F.col("own") - len(MAGIC))
        c, reached = _reachable(tmp.written(at.where("at >= 0").select("f", "split", "i", "at", "n", "jump"), "candidates"), tmp)
        if on_defect == "raise":
            headless = pieces.where("n > %d" % len(MAGIC)).select("f").distinct().join(reached.select("f").distinct(), "f", "left_anti").count()
            broken = reached.where("breaks").select("f").distinct().count()
            if broken or headless:
                raise ValueError(f"record chains break in {broken} files and have no start in {headless}; on_defect='skip' reads what is reachable")
        each = c.join(reached.select("f", "split", "run", "breaks"), ["f", "split", "run"], "left")
        # a piece that isn't a record by itself; after a break nothing is known, so the last record before it goes as well
        at, kept = Window.partitionBy("f").orderBy("at"), F.col("breaks").isNotNull()
        odd = each.where("breaks is null or jump is null or jump <> n").withColumn("rec", F.last(F.when(kept, F.col("at")), True).over(at))
        odd = odd.withColumn("until", F.last(F.when(kept, F.coalesce(F.col("at") + F.col("jump"), F.lit(-1))), True).over(at))
        inside = F.col("rec").isNotNull() & (F.col("at") < F.col("until"))
        odd = written(odd.select("i", "at", F.when(inside, F.col("rec")).alias("rec"), F.when(inside, F.col("until")).alias("until")), "odd-pieces")
    whole = pieces.join(odd.select("i"), "i", "left_anti").where(f"n > {len(MAGIC)} and jump = n").select("file", F.col("value").alias("v"))
    parts = pieces.select("i", "file", "value", "n").join(odd.where("rec is not null"), "i")
    built = parts.groupBy("file", "rec", "until").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x.value), MAGIC).alias("v"))
    built = built.where("rec + n = until").select("file", "v")
    r = whole.unionByName(built).withColumn("head", F.substring_index("v", END, 1))
    block = F.expr(f"substring(v, char_length(head) + {len(END) + 1})")
    return r.select("file", "head", F.regexp_replace(block, r"\r\n\r\n\z", "").alias("block"))


def field(name: str, pattern: str = r"([^\r]*)"):
    return F.regexp_extract("head", rf"(?:^|\r\n){name}:[ ]*{pattern}", 1)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as the archives tell them; the digest of a response is taken again from its payload."""
    with Scratch(pages.sparkSession, "warc") as tmp:
        path = tmp.path("archive")
        write(pages, path)
        r = read(pages.sparkSession, path)
    payload = F.expr("substring(block, instr(block, '\r\n\r\n') + 4)")
    response = field("WARC-Type") == "response"
    return r.select(
        field("X-Page-ID", r"(-?\d*)").try_cast("long").alias("page_id"),
        F.when(response, F.octet_length(payload).cast("long")).otherwise(field("X-Payload-Length").try_cast("long")).alias("payload_bytes"),
        F.when(response, F.sha1(F.encode(payload, "utf-8"))).otherwise(field("WARC-Payload-Digest", r"sha1:([0-9a-f]*)")).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        field("X-Refers-To-Page", r"(-?\d*)").try_cast("long").alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS m FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 1000 AND m <> page_id THEN m END AS refers_to FROM g
"""
