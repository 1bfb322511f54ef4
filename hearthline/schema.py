"""Column types, thresholds, labels and bands of the registry domain."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# These must equal the published registry rules for results to agree.

PROGRAMME_THRESHOLDS = {"AMOT": 9.3264284, "ASD": 9.743001}
PROGRAMMES = ("AMOT", "ASD", "AMOA")
UNCLASSIFIED = "NON CLASSIFIE"
UNCLASSIFIED_SPELLINGS = ("NON CLASSIFIE", "NON CLASSIFIÉ")

MAX_SCORE = 15.0
MASTER_BANDS = (0.10, 0.25, 0.50)
MIN_GAP_DAYS = 90
MAX_HISTOGRAM_SIZE = 12

ENROLMENT = "inscription"
REMOVAL = "radiation"
REQUEST_TYPES = (
    "inscription",
    "mise à jour du dossier",
    "radiation",
    "révision de score",
    "Préinscription",
    "réclamation",
)
REQUEST_LABELS = {
    "mise à jour du dossier": "Mise à jour",
    "Inscription": "Inscription",
    "radiation": "Radiation",
    "révision de score": "Révision",
    "Préinscription": "Préinscription",
    "réclamation": "Réclamation",
}
PROGRAMME_LABELS = {
    "AMOT": "AMO Tadamon (AMOT)",
    "ASD": "ASD — Aide Sociale Directe",
    "AMOA": "AMOA — Aide au Logement",
    "NON CLASSIFIE": "Non classifié — Sans programme",
}
STATUS_LABELS = {
    "gained": "A gagné l'éligibilité",
    "lost": "A perdu l'éligibilité",
    "stable": "Stable",
}
TRAJECTORY_LABELS = {
    "stable_eligible": "Stable — éligible",
    "stable_excluded": "Stable — exclu",
    "gained": "A gagné l'éligibilité",
    "lost": "A perdu l'éligibilité",
    "fluctuating": "Fluctuant",
}
GENDER_SYNONYMS = {
    "Masculin": "Homme",
    "Male": "Homme",
    "M": "Homme",
    "1": "Homme",
    "Feminin": "Femme",
    "Féminin": "Femme",
    "Female": "Femme",
    "F": "Femme",
    "2": "Femme",
}
ALWAYS_ELIGIBLE = "toujours éligible"
NEVER_ELIGIBLE = "jamais éligible"
LOST_FOR_GOOD = "perdu sans retour"
GAP_BUCKETS = (
    (30, "1–30 j (exclu)"),
    (60, "31–60 j (exclu)"),
    (90, "61–90 j (exclu)"),
    (180, "91–180 j"),
)
LAST_GAP_BUCKET = "> 180 j"
SNAPSHOT_LABELS = {
    "raw_menage": "Données démographiques des ménages",
    "raw_scores": "Événements de score (après nettoyage)",
    "master_events": "Événements enrichis (score + ménage + programme)",
    "delta_frame": "Variations de score entre événements consécutifs (ΔISE)",
    "menage_timeline": "Résumé par ménage et par programme",
    "menage_trajectory": "Trajectoire complète de chaque ménage",
    "programme_AMOT": "Événements du programme AMOT",
    "programme_ASD": "Événements du programme ASD",
    "programme_AMOA": "Événements du programme AMOA",
    "raw_programmes": "Listes d'affiliation aux programmes",
    "rejected_lines": "Lignes des fichiers sources rejetées à la lecture",
}
# metric -> (label, note)
QC_TEXTS = {
    "scores_raw_rows": (
        "Lignes brutes score chargées",
        "Volume brut de score.csv comparé au dataset final après nettoyage.",
    ),
    "scores_duplicate_rows": (
        "Doublons exacts (scores)",
        "Lignes retirées au nettoyage (doublons et autres exclusions avant dataset final).",
    ),
    "scores_aberrant": (
        "Scores aberrants (> max)",
        "Scores avec score_final > {limit} exclus.",
    ),
    "menage_raw_rows": (
        "Lignes brutes ménage chargées",
        "Volume brut de menage.csv comparé au dataset ménage nettoyé.",
    ),
    "menage_duplicate_ids": (
        "Doublons ID ménage",
        "Conservation de la première occurrence par menage_ano.",
    ),
    "menage_no_score": (
        "Ménages sans score associé",
        "Ménages présents dans le référentiel sans événement score.",
    ),
    "menage_non_classifie": (
        "Ménages non classifiés",
        "Ménages non appariés aux listes programme AMOT/ASD/AMOA.",
    ),
    "scores_rejected_rows": (
        "Lignes illisibles (scores)",
        "Enregistrements de score.csv rejetés à la lecture, conservés dans rejected_lines.",
    ),
    "menage_rejected_rows": (
        "Lignes illisibles (menage)",
        "Enregistrements de menage.csv rejetés à la lecture, conservés dans rejected_lines.",
    ),
    "programmes_rejected_rows": (
        "Lignes illisibles (programmes)",
        "Enregistrements de programmes.csv rejetés à la lecture, conservés dans rejected_lines.",
    ),
    "beneficiaire_rejected_rows": (
        "Lignes illisibles (beneficiaire)",
        "Enregistrements de beneficiaire.csv rejetés à la lecture, conservés dans rejected_lines.",
    ),
}

HOUSEHOLD_TYPES = {
    "menage_ano": "long",
    "milieu": "string",
    "region_id": "long",
    "region": "string",
    "province_id": "long",
    "province": "string",
    "commune_id": "long",
    "commune": "string",
    "type_menage": "string",
    "taille_menage": "long",
    "etat_matrimonial_cm": "string",
    "genre_cm": "string",
    "sexe_id": "long",
    "date_naissance_cm": "timestamp",
}
SCORE_TYPES = {
    "menage_ano": "long",
    "score_id_ano": "long",
    "type_demande": "string",
    "score_corrige": "double",
    "score_calcule": "double",
    "date_calcul": "timestamp",
}
PROGRAMME_TYPES = {"menage_ano": "long", "programme": "string"}
BENEFICIARY_TYPES = {
    "menage_ano": "long",
    "partner_id": "string",
    "motif": "string",
    "date_insert": "timestamp",
    "actif": "boolean",
}
HOUSEHOLD_TEXT = (
    "milieu",
    "region",
    "province",
    "commune",
    "type_menage",
    "etat_matrimonial_cm",
    "genre_cm",
)

# words that stand for a missing value in a source file
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
# --- end of fixed values ----------------------------------------------------

# Histogram cell widths used to locate exact quantiles (operators/quantiles.py).
SCORE_CELL = 0.01
RATE_CELL = 0.0001
# Series lay their histogram out over all period points, so their cells are wider.
SERIES_CELL = 0.02

# Registry dates carry no zone, so instants are TIMESTAMP_NTZ throughout.
SPARK_TYPES = {
    "long": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampNTZType(),
}


def struct_of(types: dict[str, str]) -> T.StructType:
    """Spark schema for one of the ``*_TYPES`` maps."""
    return T.StructType([T.StructField(n, SPARK_TYPES[t]) for n, t in types.items()])
