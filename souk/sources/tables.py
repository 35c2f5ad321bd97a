"""Table sources (S1-S3): parquet snapshots, a JDBC reader, the category seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.sources.schemas import SCHEMAS, cast_types


def load_tables(spark: SparkSession, base: str, tables=None) -> dict[str, DataFrame]:
    """One parquet directory per table under ``base``, read with its declared schema
    (no inference; columns absent from the files read as null)."""
    out = {}
    for t in tables or SCHEMAS:
        out[t] = spark.read.schema(SCHEMAS[t]).parquet(f"{base}/{t}")
    return out


def load_jdbc(spark: SparkSession, url: str, table: str, part_col: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 64,
              properties: dict[str, str] | None = None, cast: bool = True) -> DataFrame:
    """A partitioned JDBC read of one table.

    With ``part_col`` and ``bounds`` Spark issues ``partitions`` range queries in
    parallel instead of one connection reading the whole table. The driver jar
    must be on the classpath; ``jdbc_options`` shows the options offline.
    """
    reader = spark.read.format("jdbc").options(**jdbc_options(url, table, part_col, bounds, partitions,
                                                             properties))
    df = reader.load()
    return cast_types(df, table) if cast and table in SCHEMAS else df


def jdbc_options(url: str, table: str, part_col=None, bounds=None, partitions: int = 64,
                 properties=None) -> dict[str, str]:
    opts = {"url": url, "dbtable": table, "fetchsize": "10000"}
    if part_col and bounds:
        opts.update(partitionColumn=part_col, lowerBound=str(bounds[0]), upperBound=str(bounds[1]),
                    numPartitions=str(partitions))
    opts.update(properties or {})
    return opts


# The category seed (name, slug, icon, description, sort order).
CATEGORY_SEED = [
    ("Дизайн", "design", "🎨", "Логотипы, UI/UX, иллюстрации, брендинг", 1),
    ("Программирование", "programming", "💻", "Сайты, приложения, боты, автоматизация", 2),
    ("Тексты", "writing", "✍️", "Копирайтинг, SEO, переводы, рерайтинг", 3),
    ("Маркетинг", "marketing", "📣", "SMM, реклама, аналитика, email-маркетинг", 4),
    ("Видео", "video", "🎬", "Монтаж, анимация, съёмка, моушн-дизайн", 5),
    ("Фото", "photo", "📸", "Обработка фото, ретушь, предметная съёмка", 6),
    ("Музыка и аудио", "audio", "🎵", "Сочинение, сведение, озвучка, джинглы", 7),
    ("Анимация и 3D", "animation", "🎭", "2D/3D анимация, визуализация, моделирование", 8),
    ("Аккаунтинг", "accounting", "📊", "Бухгалтерия, налоги, финансовый учёт", 9),
    ("Юридические", "legal", "⚖️", "Договоры, консультации, регистрация бизнеса", 10),
    ("Обучение", "education", "📚", "Репетиторство, онлайн-курсы, вебинары", 11),
    ("ИИ и нейросети", "ai", "🤖", "Промпты, fine-tuning, автоматизация с ИИ", 12),
    ("Мобильные", "mobile", "📱", "iOS, Android, Flutter, React Native", 13),
    ("Игры", "games", "🎮", "Разработка игр, моддинг, геймдизайн", 14),
    ("Другое", "other", "🔧", "Прочие цифровые услуги", 15),
]


def seed_categories(categories: DataFrame) -> DataFrame:
    """S3: insert the seed rows whose slug is absent (existing slugs are kept, as
    INSERT IGNORE does); new ids continue after the largest id."""
    spark = categories.sparkSession
    seed = spark.createDataFrame(CATEGORY_SEED, "name string, slug string, icon string, description string, "
                                                "sort_order int")
    cols = [c for c in ("id", "name", "slug", "icon", "description", "sort_order") if c in categories.columns]
    new = seed.join(categories.select("slug"), "slug", "left_anti")
    maxid = categories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_m"))
    from pyspark.sql import Window
    new = (new.crossJoin(F.broadcast(maxid))
           .withColumn("id", (F.col("_m") + F.row_number().over(Window.orderBy("sort_order", "slug"))).cast("int")))
    return categories.select(*cols).unionByName(new.select(*cols))
