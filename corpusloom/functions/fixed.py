"""Words, openings and patterns that results depend on, as they are given."""

UNINFORMATIVE = ["topic", "topics", "sujet", "sujets", "resource", "resources", "ressource", "ressources"]
RESOURCE_OPENINGS = ["these resources address", "these resources from medlineplus", "ces ressources concernent", "les ressources suivantes"]
SEMANTIC_UNINFORMATIVE = [
    "topic", "topics", "resource", "resources", "reference", "references", "more information", "additional information",
    "sujet", "sujets", "ressource", "ressources", "référence", "références", "plus d informations", "informations complémentaires",
]
SEMANTIC_RESOURCE_OPENINGS = [
    "these resources address", "the following resources", "for more information", "additional resources",
    "resources for health professionals", "resources for patients", "you can find more information",
    "ces ressources concernent", "les ressources suivantes", "pour plus d informations", "ressources complémentaires",
    "ressources pour les professionnels de santé", "ressources pour les patients", "vous trouverez plus d informations",
]
NAVIGATION_OPENINGS = [
    "click here", "read more", "learn more", "see also", "visit ", "cliquez ici", "lire la suite", "en savoir plus",
    "voir aussi", "consultez ", "visitez ",
]
CHAT_TOKEN = r"<\|(?:im_start|im_end|endoftext|eot_id|start_header_id|end_header_id)\|>|\[/?INST\]"
CONTEXT_REFERENCE = (
    r"(?i)\b(?:ci-dessus|ci-dessous|comme indiqué précédemment|question précédente|résultats précédents|voir plus haut|"
    r"as described above|as mentioned above|previous question|previous results|above-mentioned)\b"
)
EXTERNAL_REFERENCE = (
    r"(?i)\b(?:figure|image|illustration|tableau|annexe|fig\.?|table|appendix)"
    r"\s*(?:ci[- ]jointe?|ci[- ]dessous|suivant(?:e)?|above|below|n[°ºo]?\s*\d+|\d+)"
)
TEXT_ANOMALY = r"\ufffd|[\x00-\x08\x0b\x0c\x0e-\x1f]|(?i:\b(\w+)\s+\1\s+\1\b)|([^\w\s])\2{9,}"
CASE_REFERENCE = (
    r"(?i)\b(?:ce patient|cette patiente|ce cas|dans ce cas|ces résultats|ci-dessus|"
    r"this patient|this case|these results|above|précédent(?:e|es|s)?)\b"
)
REWRITE_FORBIDDEN = r"(?i)\bP[123]\b|priorit|niveau d'urgence|classification|triage|\btri\b|synth|fictif|projet|projected|metadata|métadonn"
INFORMATIVE_FLAGS = ["HIGH_RISK", "DPO_LENGTH_BIAS", "LANGUAGE_MISMATCH"]
GROUNDING_GENERIC = [
    "assessment", "immediate", "emergency", "department", "reported", "clinical", "information",
    "includes", "findings", "warrant", "patient", "requires", "prompt", "deferred", "evaluation",
    "immédiate", "urgences", "nécessite", "rapide", "évaluation", "patiente", "situation",
    "symptômes", "symptoms", "condition", "together", "because", "without", "suggest", "suggests",
    "needs", "scheduled", "consultation", "surveillance", "prise", "charge", "medical", "médicale",
]
CONFIDENCE_ROUTING = {"high": 1.0, "medium": 0.7, "low": 0.4}
VERDICT_RANK = {"PASS": 0, "REVIEW": 1, "FAIL": 2}

#: category, replacement, patterns (letter case does not count where ``cased`` lacks the category).
RECOGNIZERS = [
    ("EMAIL_ADDRESS", "[EMAIL]", [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"]),
    ("URL", "[URL]", [r"https?://[^\s<>\"]+"]),
    ("IP_ADDRESS", "[IP]", [r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"]),
    ("FR_NIR", "[IDENTIFIER]", [r"\b[12]\s?\d{2}(?:\s?\d{2}){5}\s?\d{2}\b"]),
    ("PATIENT_ID", "[IDENTIFIER]", [
        r"\b(?:patient\s*(?:id|identifier)|n[°ºo]\s*(?:de\s*)?dossier|dossier\s*(?:id|n[°ºo])|medical\s*record\s*(?:id|number)|mrn)\s*[:=#-]?\s*[A-Za-z0-9_-]{3,}\b",
    ]),
    ("DATE_OF_BIRTH", "[DATE]", [
        r"\b(?:né|née)\s+(?:le\s+)?(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2})\b",
        r"\b(?:born|date\s+of\s+birth|dob)\s*(?:on|:|=)?\s*(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2})\b",
    ]),
    ("IDENTITY_INTRODUCTION", "[NAME]", [
        r"\b(?:my\s+name\s+is|i\s+am\s+called|i['’]?m\s+called|je\s+m['’]appelle|mon\s+nom\s+est)\s+[A-Za-zÀ-ÖØ-öø-ÿ'’-]+(?:\s+[A-Za-zÀ-ÖØ-öø-ÿ'’-]+){0,3}\b",
    ]),
    ("PHONE_NUMBER", "[PHONE]", [r"\+?[0-9]{2,3}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){2,4}\b"]),
]
#: How sure a recognizer is of its matches; of two at one place the surer one counts.
RECOGNIZER_SCORES = {
    "EMAIL_ADDRESS": 1.0, "URL": 0.6, "IP_ADDRESS": 0.6, "FR_NIR": 0.85, "PATIENT_ID": 0.8, "DATE_OF_BIRTH": 0.8,
    "IDENTITY_INTRODUCTION": 0.85, "PHONE_NUMBER": 0.6,
}
CASED = ["EMAIL_ADDRESS", "URL", "IP_ADDRESS", "FR_NIR", "PHONE_NUMBER"]

#: Reasons of the semantic dimensions; {} stands for what was found.
SEMANTIC_REASONS = {
    "no_input": "Entrée SFT vide.",
    "no_answer": "Réponse SFT vide.",
    "blocked_answer": "Réponse ouverte impropre au SFT : {}.",
    "doubtful_answer": "Réponse ouverte à vérifier : {}.",
    "no_labels": "QCM sans réponse correcte.",
    "unknown_labels": "Labels absents des choix : {}.",
    "hollow_labels": "Choix corrects sans contenu : {}.",
    "language": "Langue détectée '{}' différente de '{}'.",
    "autonomy": "Autonomie à vérifier : {}.",
    "open_leak": "Réponse ouverte déjà présente dans l’entrée.",
    "label_leak": "Label correct '{}' explicitement révélé.",
    "pair_leak": "Réponse DPO '{}' déjà présente dans le prompt.",
    "text": "Anomalie textuelle à vérifier.",
    "no_prompt": "Prompt DPO vide.",
    "no_chosen": "Réponse chosen vide.",
    "no_rejected": "Réponse rejected vide.",
    "same_pair": "Les réponses chosen et rejected sont identiques.",
    "contradiction": "Contradiction de préférence DPO.",
    "length_bias": "Biais de longueur potentiel.",
    "high_risk": "Contenu médical à haut risque.",
}
SEMANTIC_BLOCKING = ["NAVIGATION_ONLY_ANSWER", "RESOURCE_ONLY_ANSWER", "UNINFORMATIVE_ANSWER"]
SEMANTIC_DOUBTFUL = ["QUESTION_AS_ANSWER", "VERY_SHORT_OPEN_ANSWER"]
#: The right label told in the question; {} stands for the label in lower case.
LABEL_REVEALED = r"\b(?:correct answer|right answer|answer|bonne reponse|reponse correcte)\s*(?:is|est|:)?\s*{}\b"
