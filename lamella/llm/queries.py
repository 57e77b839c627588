"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard_join, media, mixing, oracles, packing, quality_model, quality_rules, secrets, token_files, url_filter
from . import common as C


def n_words() -> Column:
    return F.size(C.words(C.whole("text"))).cast("long")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(C.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    digest = F.sha2(secrets.joined(F.col("base")).cast("binary"), 256)
    return out.select("row.doc_id", count("assign"), count("access"), count("hex"), digest.alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.link(C.table(spark, sf_dir, "documents"), words=4, num=85, den=100)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = chat.chat(C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))
    read = chat.read_turns(F.col("formatted"))
    out = out.select("conv_id", "n_messages", "formatted", read.alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_messages",
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(C.table(spark, sf_dir, "documents"))
    stats = [f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("row.doc_id", *stats, "base_failed", "kept", "soft_failed", F.round("host_rate", 6).alias("host_rate"), "bad_host")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@C.tidy
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are those of the token files, end ids included."""
    docs = C.table(spark, sf_dir, "documents").withColumn("digest", F.md5(C.whole("text")))
    sized = C.stored(token_files.lengths(docs, tokenizer=tokenizer_path(), keep=("doc_id", "digest")), "lengths")
    out = packing.pack(sized, F.col("n_tokens"), ties=F.col("digest"))
    return out.select("doc_id", "n_tokens", F.col("bucket").cast("long").alias("bucket"), "bucket_len", "batch", "slot")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = token_files.folder(spark)
    token_files.write(C.table(spark, sf_dir, "documents"), where, tokenizer=tokenizer_path())
    return token_files.read(spark, where, ids=False)


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    metadata = {"n_chars": F.coalesce(F.col("n_chars"), F.length("text"))}
    machine = quality_model.fit(docs, C.table(spark, sf_dir, "labels"), learn_from=~held_out, metadata=metadata)
    out = quality_model.score(docs, machine, metadata=metadata).select("row.doc_id", "score")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: host, path, action
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's url ends in the number of the document that it shows; the labels of those documents are the labelled outcomes."""
    pages = C.table(spark, sf_dir, "pages").select("page_id", "url")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    labels = C.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("n"), bad)
    labelled = pages.select("url", F.regexp_extract("url", r"/(\d{1,18})[^/\d]*/?(?:[?#].*)?$", 1).try_cast("long").alias("n")).join(labels, "n").select("url", "bad")
    out = url_filter.judge(pages, URL_RULES, labelled)
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("bad_bound", 6).alias("bad_bound"))


@C.tidy
def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a page: its source's name as a figure, half of its lines, its whole text as a figure, the other lines.

    Figures refer to stored media by the digest of the padded payload; those of a source are shared by its documents. The texts of the pages'
    items are counted and left behind before the media are looked up.
    """
    docs = C.table(spark, sf_dir, "documents").select("doc_id", C.whole("text").alias("text"), C.whole("source").alias("source"))
    payload = lambda c: media.padded(F.col(c).cast("binary"))
    where = media.folder(spark)
    media.store(docs.select(payload("text").alias("payload")).unionByName(docs.select("source").distinct().select(payload("source").alias("payload"))), where)
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    figure = lambda c, caption: F.concat(F.lit('<figure><img src="'), F.sha2(payload(c), 256), F.lit('"><figcaption>'), escaped(caption), F.lit("</figcaption></figure>"))
    lines = F.split("text", "\n", -1)
    half = F.floor(F.size(lines) / 2).cast("int")
    part = lambda some: F.concat(F.lit("<p>"), escaped(F.array_join(some, "\n")), F.lit("</p>"))
    name = F.concat(F.lit("Text of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    page = F.concat(figure("source", F.col("source")), part(F.slice(lines, 1, half)), figure("text", name), part(F.slice(lines, half + 1, F.size(lines))))
    pages = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), page.alias("html"))
    light = F.transform("items", lambda i: F.struct(*[i[c].alias(c) for c in ("pos", "nth", "kind", "ref", "caption")], F.length(i["text"]).alias("chars")))
    sequences = C.stored(media.interleave(pages, keep=("doc_id", "n_bytes")).select("row", "page", light.alias("items")), "sequences")
    out = media.resolve(sequences, media.describe(spark, where))
    shown = F.filter("items", lambda i: i["kind"] == "media")
    chars = F.aggregate(F.filter("items", lambda i: i["kind"] == "text"), F.lit(0).cast("long"), lambda n, i: n + i["chars"])
    out = out.select("row.doc_id", "row.n_bytes", F.get(shown, 1).alias("i"), F.get(shown, 0).alias("s"), F.size("items").cast("long").alias("n_items"), chars.alias("text_chars"))
    fields = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return out.select(
        "doc_id", "n_bytes", *[F.col(f"i.media.{c}").alias(c) for c in fields], F.col("i.caption").alias("caption"), F.col("i.pos").cast("long").alias("pos"),
        F.col("s.caption").alias("source_caption"), F.col("s.media.payload_sha256").alias("source_sha256"), "n_items", "text_chars",
    )


@C.tidy
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "source", n_words().alias("n_words"), F.md5(C.whole("text")).alias("digest"))
    out = mixing.mix(C.stored(docs, "lengths"), F.col("n_words"), ties=F.col("digest"))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scan, op2_jaccard_join, op3_chat_format, op4_quality_rules, op5_packing, op6_token_files, op7_quality_model, op8_url_filter, op9_media, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql(URL_RULES)
