"""Question files and image listings on disk, with their paths as partition keys.

Layout: ``base/{split_dir}/{category}/{dataset}/{imagesTr|imagesVal|imagesTs}/*`` and
``{dataset}_questions_{train|val_withGT|val|test}.json`` beside the image folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mossgrid.plans.runtime import spread

# Split, its folder, image folder, question file ending, priority.
PLACES = [
    ("train", "training", "imagesTr", "train", 0),
    ("val", "validation-hidden", "imagesVal", "val_withGT", 0),
    ("val", "validation-hidden", "imagesVal", "val", 1),
    ("val", "validation-public", "imagesVal", "val", 2),
    ("test", "testing", "imagesTs", "test", 0),
]
# The known datasets by category, and the subset for trials.
REGISTRY = {
    "Retinography": ["retino", "fundus"],
    "Ultrasound": ["BUSI-det", "BUS-UCLM-det", "BUSI", "BUS-UCLM", "iugc"],
    "Xray": ["boneresorption", "dental", "periapical", "IU_XRay", "chestdr"],
    "Clinical": ["neojaundice"],
    "Microscopy": ["chromosome", "neurips22cell", "bone_marrow"],
    "Endoscopy": ["endo"],
    "Dermatology": ["bcn20000"],
    "Mammography": ["CMMD"],
}
TRIAL = ["retino", "BUSI-det", "boneresorption"]
FIELDS = ["Question", "Answer", "TaskType", "Modality", "ImageName"]
SCHEMA = ", ".join(f"{f} string" for f in [*FIELDS, "Split", "_corrupt_record"])
# Where a submission looks for question files and images, in order.
SEARCH = ["_questions_val\\.json$", "_questions\\.json$", "questions[^/]*\\.json$", "/questions[^/]*\\.json$"]
IMAGE_DIRS = ["imagesVal", "imagesTs", "images", "Images", "img", ""]
IMAGE_PREFIXES = ["imagesVal/", "imagesTs/", "images/", "Images/", "img/"]
SEARCH_NAMES = "*questions*.json"
IMAGE_ENDINGS = r"(?i)\.(jpg|jpeg|png|bmp|tiff|tif)$"
IMAGE_NAMES = "*.{jpg,jpeg,png,bmp,tiff,tif,JPG,JPEG,PNG,BMP,TIFF,TIF}"


def registry(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(dataset, category) of the known datasets, or of some."""
    rows = [(n, c) for c, ns in REGISTRY.items() for n in ns if names is None or n in names]
    return spark.createDataFrame(rows, "dataset string, category string")


def listing(spark: SparkSession, base: str) -> DataFrame:
    """All files under a folder: path, rel (below it), n_bytes. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    return files.select(_plain(F.col("path")).alias("path"), F.col("length").alias("n_bytes")).withColumn(
        "rel", F.regexp_replace("path", "^.*?" + _literal(base.rstrip("/")) + "/", "")
    )


def _plain(path: Column) -> Column:
    """A local path without its scheme; others keep theirs."""
    return F.regexp_replace(path, "^file:/*(?=/)", "")


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def valid_image(head: Column) -> Column:
    """Whether bytes begin as an image file does (JPEG, PNG, BMP, GIF, TIFF)."""
    return F.coalesce(F.hex(head).rlike("^(FFD8FF|89504E470D0A1A0A|424D|47494638|49492A00|4D4D002A)"), F.lit(False))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        heads = []
        for path in batch.column("path").to_pylist():
            try:
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as file:
                    heads.append(file.read(8))
            except OSError:
                heads.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(heads, pa.binary())], ["path", "head"])


def checked_images(spark: SparkSession, base: str, *, decode: bool = False) -> DataFrame:
    """(path, ok) of all image files under a folder.

    By default the first bytes decide, which are all that is read of a file. With ``decode``
    every image is decoded as a whole, so that cut-off and damaged ones fail.
    """
    if decode:
        read = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", IMAGE_NAMES).load(base)
        return read.select(_plain(F.col("image.origin")).alias("path"), (F.col("image.nChannels") > 0).alias("ok"))
    files = listing(spark, base).where(F.col("path").rlike(IMAGE_ENDINGS))
    heads = spread(files.select("path"), "path").mapInArrow(_heads, "path string, head binary")
    return heads.select("path", valid_image(F.col("head")).alias("ok"))


def placed_files(files: DataFrame) -> DataFrame:
    """Question files by (split, split_dir, category, dataset): the one of highest priority.

    A hidden validation folder, once there, keeps the public one out, even if it holds no
    question file.
    """
    part = lambda i: F.get(F.split("rel", "/"), F.lit(i))
    tree = files.select("path", "rel", part(0).alias("split_dir"), part(1).alias("category"), part(2).alias("dataset"))
    hidden = tree.where("split_dir = 'validation-hidden'").select("category", "dataset").distinct()
    cases = F.lit(None).cast("struct<split:string,priority:int>")
    for split, folder, _, ending, priority in reversed(PLACES):
        fits = (F.col("split_dir") == folder) & (
            F.col("rel") == F.concat_ws("/", F.lit(folder), "category", "dataset", F.concat("dataset", F.lit(f"_questions_{ending}.json")))
        )
        cases = F.when(fits, F.struct(F.lit(split).alias("split"), F.lit(priority).alias("priority"))).otherwise(cases)
    found = tree.withColumn("place", cases).where("place IS NOT NULL").select("*", "place.*").drop("place")
    public = found.where("split_dir = 'validation-public'").join(hidden, ["category", "dataset"], "left_anti")
    open_ = found.where("split_dir <> 'validation-public'").unionByName(public)
    rank = F.row_number().over(Window.partitionBy("split", "category", "dataset").orderBy("priority"))
    return open_.withColumn("r", rank).where("r = 1").select("split", "split_dir", "category", "dataset", "path")


def read_questions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of JSON array files with path and place in the file, from 1.

    Every field is text; lists and numbers come as their JSON text. A file that is no JSON
    gives one row with ``_corrupt_record`` set instead of failing the job.
    """
    if not paths:
        return spark.createDataFrame([], f"{SCHEMA}, path string, pos int")
    return _placed(_reader(spark).json(paths))


def read_found_questions(spark: SparkSession, base: str) -> DataFrame:
    """Records of all question files under a folder, found by their names while reading."""
    return _placed(_reader(spark).option("recursiveFileLookup", True).option("pathGlobFilter", SEARCH_NAMES).json(base))


def _reader(spark: SparkSession):
    return spark.read.schema(SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record")


def _placed(raw: DataFrame) -> DataFrame:
    placed = raw.withColumn("path", _plain(F.col("_metadata.file_path"))).withColumn("__at", F.monotonically_increasing_id())
    order = Window.partitionBy("path").orderBy("__at")  # one file: one array, read by one task
    return placed.withColumn("pos", F.row_number().over(order)).drop("__at")


def search_question_files(files: DataFrame) -> DataFrame:
    """Question files for a submission, each once, in the order of the patterns that find
    them and of their paths; files with the answers are left out."""
    number = F.lit(None).cast("int")
    for i, pattern in reversed(list(enumerate(SEARCH))):
        number = F.when(F.col("path").rlike(pattern), i).otherwise(number)
    name = F.substring_index("path", "/", -1)
    return files.select("path", number.alias("pattern")).where(F.col("pattern").isNotNull() & ~name.contains("withGT"))


def image_folders(questions: DataFrame, files: DataFrame) -> DataFrame:
    """(path of the question file, folder): its first image folder that holds an image."""
    parent = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    holding = files.where(F.col("path").rlike(IMAGE_ENDINGS)).select(parent("path").alias("folder")).distinct()
    candidates = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(IMAGE_DIRS)])
    wanted = questions.select("path", F.explode(candidates).alias("x")).select(
        "path", "x.i", F.regexp_replace(F.concat_ws("/", parent("path"), "x.d"), "/$", "").alias("folder")
    )
    return wanted.join(holding, "folder").groupBy("path").agg(F.min_by("folder", "i").alias("folder"))


def bare_image_name(name: Column) -> Column:
    """Image name without the first known folder prefix that it begins with (all of its
    occurrences go)."""
    out = name
    for prefix in reversed(IMAGE_PREFIXES):
        out = F.when(name.startswith(prefix), F.replace(name, F.lit(prefix), F.lit(""))).otherwise(out)
    return out
