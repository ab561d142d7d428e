"""Terms too general to tell a rule on their own, by language, and those of the scored match."""

GENERIC_TERMS = {
    "fr": [
        "douleur", "douleurs", "maladie", "infection", "traumatisme",
        "urgence", "patient", "symptome", "symptomes", "signe", "signes",
        "froid", "chaud", "rouge", "masse", "estomac", "intestins",
        "enfant", "comportement",
    ],
    "en": [
        "pain", "painful", "disease", "infection", "trauma",
        "emergency", "patient", "symptom", "symptoms", "sign", "signs",
        "cold", "warm", "red", "mass", "stomach", "intestines",
        "child", "behavior",
    ],
}
SCORED_GENERIC_TERMS = ["infection", "pain", "douleur", "fever", "fievre", "bleeding", "saignement"]
WHOLE_SCORE, PARTIAL_SCORE, FIELD_SCORE = 2.0, 1.0, 0.5
PARTIAL_SHARE, LEAST_WORDS, LEAST_LETTERS = 0.75, 2, 4
LEAST_SCORE, LEAST_MARGIN, SHOWN_CANDIDATES = 2.0, 1.0, 5
