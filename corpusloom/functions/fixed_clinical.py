"""Fixed values of clinical extraction: patterns (letter case never counts), limits and number words."""

PATIENT_SEX = {
    "male": [
        r"\b(?:homme|garçon|petit\s+garçon|blessé|nouveau[- ]né|patient\s+masculin|sexe\s+masculin|male\s+patient|man|boy|male)\b",
    ],
    "female": [
        r"\b(?:femme|fille|petite\s+fille|patiente|blessée|nouvelle[- ]née|patient\s+féminin|sexe\s+féminin|female\s+patient|woman|girl|female)\b",
    ],
}
AGE = {
    "age_days": [
        r"\b(?:nouveau[- ]né(?:e)?|nourrisson|bébé|bebe|patient(?:e)?|garçon|fille)(?:\s+\w+){0,5}\s+âgé(?:e)?\s+de\s+(\d{1,2})\s*jours?\b",
        r"\b(?:nouveau[- ]né(?:e)?|nourrisson|bébé|bebe|(?:petit\s+)?garçon|(?:petite\s+)?fille)\s+de\s+(\d{1,2})\s*jours?\b",
        r"\bâge\s*[:=]?\s*(\d{1,2})\s*jours?\b",
        r"\b(\d{1,2})[\s-]*days?[\s-]*old\b",
        r"\b(?:newborn|infant|baby|boy|girl|patient)(?:\s+\w+){0,5}\s+aged\s+(\d{1,2})\s*days?\b",
    ],
    "age_months": [
        r"\b(?:nourrisson|bébé|bebe|enfant|patient(?:e)?|garçon|fille)(?:\s+\w+){0,5}\s+âgé(?:e)?\s+de\s+(\d{1,2})\s*mois\b",
        r"\b(?:nourrisson|bébé|bebe|(?:jeune\s+)?enfant|(?:petit\s+)?garçon|(?:petite\s+)?fille)\s+de\s+(\d{1,2})\s*mois\b",
        r"\bâge\s*[:=]?\s*(\d{1,2})\s*mois\b",
        r"\b(\d{1,2})[\s-]*months?[\s-]*old\b",
        r"\b(?:infant|baby|child|boy|girl|patient)(?:\s+\w+){0,5}\s+aged\s+(\d{1,2})\s*months?\b",
    ],
    "age_years": [
        r"\b(?:jeune\s+)?(?:patient(?:e)?|homme|femme|garçon|fille|enfant|adolescent(?:e)?|blessé(?:e)?|malade|sujet)\s+de\s+(\d{1,3})\s*ans?\b",
        r"\b(?:patient(?:e)?|homme|femme|garçon|fille|enfant|adolescent(?:e)?|blessé(?:e)?|malade|sujet)(?:\s+\w+){0,5}\s+âgé(?:e)?\s+de\s+(\d{1,3})\s*ans?\b",
        r"\bâge\s*[:=]?\s*(\d{1,3})\s*ans?\b",
        r"\[NAME\]\s*,?\s*(?:âgé(?:e)?\s+de\s+)?(\d{1,3})\s*ans?\b",
        r"\b(\d{1,3})[\s-]*year[\s-]*old\s+(?:man|woman|boy|girl|male|female|patient)\b",
        r"\b(\d{1,3})[\s-]*years?[\s-]*old\b",
        r"\b(?:man|woman|boy|girl|male|female|patient)(?:\s+\w+){0,5}\s+aged\s+(\d{1,3})\b",
        r"\b(\d{1,3})\s*(?:yo|y/o)\b",
    ],
}
WORD_AGE = [
    r"\b(?:jeune\s+)?(?:patient(?:e)?|homme|femme|garçon|fille|enfant|adolescent(?:e)?|blessé(?:e)?|malade)\s+de\s+([a-zàâçéèêëîïôûùüÿ-]+(?:\s+(?:et\s+)?[a-zàâçéèêëîïôûùüÿ-]+){0,3})\s+ans\b",
    r"\b(?:patient(?:e)?|homme|femme|garçon|fille|enfant|adolescent(?:e)?|blessé(?:e)?|malade)(?:\s+\w+){0,5}\s+âgé(?:e)?\s+de\s+([a-zàâçéèêëîïôûùüÿ-]+(?:\s+(?:et\s+)?[a-zàâçéèêëîïôûùüÿ-]+){0,3})\s+ans\b",
]
NUMBER_UNITS = {
    "zéro": 0, "zero": 0, "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7, "huit": 8, "neuf": 9,
    "dix": 10, "onze": 11, "douze": 12, "treize": 13, "quatorze": 14, "quinze": 15, "seize": 16, "dix-sept": 17, "dix-huit": 18, "dix-neuf": 19,
}
NUMBER_TENS = {"vingt": 20, "trente": 30, "quarante": 40, "cinquante": 50, "soixante": 60}
TEMPERATURE = [
    r"\b(?:température|temperature|temp|t°|body\s+temperature)\s*(?:est|is)?\s*(?:à|a|de|of|at|:|=)?\s*(\d{2,3}(?:\s*[.,]\s*\d+)?)\s*°?\s*(c|f|celsius|fahrenheit)?\b",
    r"\b(\d{2}(?:\s*[.,]\s*\d+)?)\s*°\s*(c|f|celsius|fahrenheit)\b",
]
PRESSURE_CMHG = [
    r"\b(?:ta|pa|bp|pression\s+artérielle|pression\s+arterielle|tension\s+artérielle|tension\s+arterielle|blood\s+pressure)\s*(?:est|is)?\s*(?:à|a|de|of|at|:|=)?\s*(\d{1,2}(?:[.,]\d+)?)\s*[/\-]\s*(\d{1,2}(?:[.,]\d+)?)\s*(?:cm\s*hg|cmhg)\b",
]
PRESSURE_MMHG = [
    r"\b(?:ta|pa|bp|pression\s+artérielle|pression\s+arterielle|tension\s+artérielle|tension\s+arterielle|blood\s+pressure)\s*(?:est|is)?\s*(?:à|a|de|of|at|:|=)?\s*(\d{2,3})\s*[/\-]\s*(\d{2,3})\s*(?:mm\s*hg|mmhg)?\b",
    r"\b(?:systolique|systolic)\s*(?:blood\s+pressure|pressure)?\s*(?:est|is)?\s*(?:à|a|de|of|at|:|=)?\s*(\d{2,3}).{0,40}?\b(?:diastolique|diastolic)\s*(?:blood\s+pressure|pressure)?\s*(?:est|is)?\s*(?:à|a|de|of|at|:|=)?\s*(\d{2,3})\b",
]
NUMBERS = {
    "systolic_bp": [
        r"\b(?:pression\s+artérielle\s+systolique|pression\s+arterielle\s+systolique|tension\s+systolique|pas|systolic\s+blood\s+pressure|systolic\s+pressure|systolic\s+bp)\s*(?:est|is)?\s*(?:à|a|de|of|at|:|=)?\s*(\d{2,3}(?:[.,]\d+)?)\s*(?:mm\s*hg|mmhg)?\b",
    ],
    "diastolic_bp": [
        r"\b(?:pression\s+artérielle\s+diastolique|pression\s+arterielle\s+diastolique|tension\s+diastolique|pad|diastolic\s+blood\s+pressure|diastolic\s+pressure|diastolic\s+bp)\s*(?:est|is)?\s*(?:à|a|de|of|at|:|=)?\s*(\d{2,3}(?:[.,]\d+)?)\s*(?:mm\s*hg|mmhg)?\b",
    ],
    "heart_rate": [
        r"\b(?:fc|hr|fréquence\s+cardiaque|frequence\s+cardiaque|heart\s+rate|pulse|pouls)\s*(?:est|is)?\s*(?:à|a|de|of|at|:|=)?\s*(\d{1,3}(?:[.,]\d+)?)\s*(?:/min|/mn|bpm|beats?\s+per\s+minute|battements?\s+par\s+minute)?\b",
        r"\b(\d{1,3}(?:[.,]\d+)?)\s*(?:bpm|beats?\s+per\s+minute|battements?\s+par\s+minute)\b",
    ],
    "spo2": [
        r"\b(?:spo2|spo₂|sao2|sat(?:uration)?(?:\s+(?:en\s+)?o2)?|oxygen\s+saturation|oxygen\s+sat|o2\s+sat(?:uration)?)\s*(?:est|is)?\s*(?:à|a|de|of|at|:|=)?\s*(\d{2,3}(?:[.,]\d+)?)\s*%?\b",
    ],
    "respiratory_rate": [
        r"\b(?:fr|rr|respiratory\s+rate|respiration\s+rate|breathing\s+rate|fréquence\s+respiratoire|frequence\s+respiratoire)\s*(?:est|is)?\s*(?:à|a|de|of|at|:|=)?\s*(\d{1,3}(?:[.,]\d+)?)\s*(?:/min|/mn|rpm|breaths?\s+per\s+minute|breaths?/min)?\b",
    ],
    "gcs": [
        r"\b(?:gcs|glasgow(?:\s+coma\s+scale)?|glasgow\s+coma\s+score|score\s+de\s+glasgow)\s*(?:score\s*)?(?:est|is)?\s*(?:à|a|de|of|at|:|=)?\s*(\d{1,2})(?:\s*/\s*15)?\b",
    ],
    "blood_glucose_mmol_l": [
        r"\b(?:glycémie|glycemie|blood\s+glucose|blood\s+sugar|glucose)\s*(?:est|is)?\s*(?:à|a|de|of|at|:|=)?\s*(\d{1,2}(?:[.,]\d+)?)\s*mmol\s*/?\s*l\b",
    ],
    "ketones_mmol_l": [
        r"\b(?:cétonémie|cetonemie|cétones?|cetones?|ketones?|ketonemia)\s*(?:est|is)?\s*(?:à|a|de|of|at|:|=)?\s*(\d{1,2}(?:[.,]\d+)?)\s*mmol\s*/?\s*l\b",
    ],
    "pain_score": [
        r"\b(?:douleur|pain)(?:\s+(?:cotée|cotee|évaluée|evaluee|score(?:d)?))?\s*(?:à|a|de|at|:|=)?\s*(\d{1,2}(?:[.,]\d+)?)\s*/\s*10\b",
        r"\b(?:eva|evs|nrs)\s*(?:à|a|:|=)?\s*(\d{1,2}(?:[.,]\d+)?)\b",
    ],
}
PLAUSIBLE = {
    "age_days": (0, 31), "age_months": (0, 23), "age_years": (0, 120), "temperature": (25.0, 45.0), "heart_rate": (20, 300),
    "systolic_bp": (30, 300), "diastolic_bp": (10, 200), "spo2": (50.0, 100.0), "respiratory_rate": (5, 100), "gcs": (3, 15),
    "blood_glucose_mmol_l": (0.1, 80.0), "ketones_mmol_l": (0.0, 20.0), "pain_score": (0.0, 10.0),
}
CMHG_TO_MMHG = 10
