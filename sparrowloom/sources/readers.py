"""Scans of manifests, annotations, labels and image folders, each with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes that count as images.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".ppm", ".bmp", ".pgm", ".tif", ".tiff", ".webp")

PAIRS = "path string, prompt string"
CONVERSATIONS = "image string, conversations array<struct<`from`: string, value: string>>"
STORIES = "images array<string>, captions array<string>"
ANNOTATION_MANIFEST = "dataset_name string, ann_json_path string, img_dir string, num_images bigint, datalist array<string>"
TRAJECTORY_MANIFEST = "dataset_name string, language_instruction_key string, observation_key array<string>, num_ep bigint, datalist array<string>, lang_aug_map map<string, array<string>>, idx_for_delta array<int>"
ANNOTATIONS = "images array<struct<id: bigint, file_name: string, coco_url: string, height: int, width: int>>, annotations array<struct<id: bigint, image_id: bigint, category_id: bigint, area: double, bbox: array<double>, iscrowd: int>>, categories array<struct<id: bigint, name: string>>"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; a bad line ends the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole files, each a JSON object or an array of them."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def manifests(spark: SparkSession, path: str, schema: str = TRAJECTORY_MANIFEST) -> DataFrame:
    """All *.json below a folder, or one file, with the file each row came from."""
    one = path.endswith(".json")
    reader = spark.read.schema(schema).option("multiLine", True)
    reader = reader if one else reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    return reader.json(path).withColumn("manifest", F.input_file_name())


def manifest_items(rows: DataFrame) -> DataFrame:
    """(dataset_name, path): the bag of all manifests' entries."""
    return rows.select("dataset_name", F.explode("datalist").alias("path"))


def image_folder(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """(path, class): image files below a folder, the class from the file's own folder.

    Content is only read if asked for: without it the scan lists files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kept = files.where(suffix.isin(*IMAGE_SUFFIXES))
    return kept.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class"), "length", *(["content"] if with_content else []))


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """(num, description) from lines `num: description`; only the first colon parts them."""
    parts = F.split("value", ":", 2)
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim(parts[0]).cast("int").alias("num"), F.trim(parts[1]).alias("description"))


def raw_image_shape(content: Column) -> Column:
    """The shape of raw frames known by their size; null for encoded images."""
    n = F.octet_length(content)
    shape = lambda h, w: F.struct(F.lit(h).alias("height"), F.lit(w).alias("width"), F.lit(3).alias("channels"))
    return F.when(n == 2764800, shape(720, 1280)).when(n == 921600, shape(480, 640))


def annotation_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations and categories as rows of their own."""
    rows = lambda c: docs.select(F.explode(c).alias("r")).select("r.*")
    return rows("images"), rows("annotations"), rows("categories")
