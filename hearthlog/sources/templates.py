"""Message bundles: one template per language and key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog import schema
from hearthlog.functions import text

# Alert texts per language.
MESSAGES = {
    "ENGLISH": {
        "comparisonOperator.ABOVE": "Above threshold",
        "comparisonOperator.BELOW": "Below threshold",
        "alertEventType.MOTION_DETECTED": "Motion detected",
        "measurement.relativeHumidity.symbol": "% RH",
        "email.alert.temperature.subject": "Temperature alert: {0}",
        "email.alert.temperature.body": (
            "An alert rule has been triggered.\n\nSensor: {0}\nHome location: {1}\nLocation: {2}, {3}\n"
            "Condition: {4}\nMeasured temperature: {5} {7}\nThreshold: {6} {7}\nRecorded at: {8}\n"
            "Cooldown: {9} minutes\n\nThis email was sent because alerts are enabled for this sensor."
        ),
        "email.alert.humidity.subject": "Humidity alert: {0}",
        "email.alert.humidity.body": (
            "An alert rule has been triggered.\n\nSensor: {0}\nHome location: {1}\nLocation: {2}, {3}\n"
            "Condition: {4}\nMeasured relative humidity: {5} {7}\nThreshold: {6} {7}\nRecorded at: {8}\n"
            "Cooldown: {9} minutes\n\nThis email was sent because alerts are enabled for this sensor."
        ),
        "email.alert.motion.subject": "Motion alert: {0}",
        "email.alert.motion.body": (
            "An alert rule has been triggered.\n\nSensor: {0}\nHome location: {1}\nLocation: {2}, {3}\n"
            "Event: {4}\nRecorded at: {5}\nCooldown: {6} minutes\n\n"
            "This email was sent because alerts are enabled for this sensor."
        ),
    },
    "TURKISH": {
        "comparisonOperator.ABOVE": "Eşik değerinin üstünde",
        "comparisonOperator.BELOW": "Eşik değerinin altında",
        "alertEventType.MOTION_DETECTED": "Hareket algılandı",
        "measurement.relativeHumidity.symbol": "% RH",
        "email.alert.temperature.subject": "Sıcaklık uyarısı: {0}",
        "email.alert.temperature.body": (
            "Bir uyarı kuralı tetiklendi.\n\nSensör: {0}\nEv içindeki konum: {1}\nKonum: {2}, {3}\n"
            "Koşul: {4}\nÖlçülen sıcaklık: {5} {7}\nEşik değeri: {6} {7}\nKayıt zamanı: {8}\n"
            "Bekleme süresi: {9} dakika\n\n"
            "Bu e-posta, bu sensör için uyarılar etkin olduğu için gönderildi."
        ),
        "email.alert.humidity.subject": "Nem uyarısı: {0}",
        "email.alert.humidity.body": (
            "Bir uyarı kuralı tetiklendi.\n\nSensör: {0}\nEv içindeki konum: {1}\nKonum: {2}, {3}\n"
            "Koşul: {4}\nÖlçülen bağıl nem: {5} {7}\nEşik değeri: {6} {7}\nKayıt zamanı: {8}\n"
            "Bekleme süresi: {9} dakika\n\n"
            "Bu e-posta, bu sensör için uyarılar etkin olduğu için gönderildi."
        ),
        "email.alert.motion.subject": "Hareket uyarısı: {0}",
        "email.alert.motion.body": (
            "Bir uyarı kuralı tetiklendi.\n\nSensör: {0}\nEv içindeki konum: {1}\nKonum: {2}, {3}\n"
            "Olay: {4}\nKayıt zamanı: {5}\nBekleme süresi: {6} dakika\n\n"
            "Bu e-posta, bu sensör için uyarılar etkin olduğu için gönderildi."
        ),
    },
}


def default_templates(spark: SparkSession) -> DataFrame:
    """The built-in bundles as a ``(lang, key, template)`` table."""
    rows = [(lang, key, template) for lang, bundle in MESSAGES.items() for key, template in bundle.items()]
    return spark.createDataFrame(rows, schema.TEMPLATES)


def read_bundle(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """Read a ``key=text`` bundle file; blank lines and ``#`` comments are skipped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    return lines.select(
        F.lit(lang).alias("lang"),
        F.regexp_extract("value", r"^\s*([^=\s]+)\s*=", 1).alias("key"),
        F.replace(
            F.regexp_extract("value", r"^[^=]*=\s*(.*)$", 1), F.lit("\\n"), F.lit("\n")
        ).alias("template"),
    ).where(F.col("key") != "")


def bundles(templates: DataFrame) -> DataFrame:
    """One row per language with all its templates as a map, each already cut into pieces."""
    cut = templates.select("lang", "key", text.template_pieces(F.col("template")).alias("pieces"))
    return cut.groupBy("lang").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "pieces"))).alias("bundle")
    )
