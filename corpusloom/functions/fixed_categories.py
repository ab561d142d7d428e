"""Medical terms, and the patterns of categories over folded text."""

MEDICAL_TERMS = [
    "symptom", "symptoms", "symptome", "symptomes", "pain", "douleur", "fever", "fievre", "dyspnea", "dyspnee", "breath", "respiration",
    "bleeding", "hemorrhage", "hemorragie", "vomiting", "vomissement", "nausea", "nausee", "cough", "toux", "fatigue", "weakness",
    "patient", "patiente", "patients", "disease", "maladie", "syndrome", "diagnosis", "diagnostic", "treatment", "traitement", "therapy", "therapie",
    "medication", "medicament", "drug", "dose", "dosage", "blood", "sang", "heart", "cardiac", "coeur", "cardiaque", "lung", "pulmonary",
    "poumon", "pulmonaire", "renal", "kidney", "rein", "hepatic", "liver", "foie", "neurological", "neurologique", "infection", "infectious",
    "infectieux", "cancer", "tumor", "tumeur", "fracture", "trauma", "traumatisme", "pregnancy", "grossesse", "surgery", "chirurgie",
    "emergency", "urgence", "clinical", "clinique", "examination", "examen", "test", "analyse", "pressure", "tension", "temperature", "pulse", "pouls",
    "oxygen", "oxygene", "saturation",
]
TRIAGE = {
    "RESPIRATORY_DISTRESS": [r"\bdyspn", r"\bdetresse respiratoire\b", r"\bdifficulte respiratoire\b", r"\bshortness of breath\b", r"\brespiratory distress\b", r"\bhypoxi", r"\bcyan", r"\bsaturation\b", r"\bspo2\b"],
    "CONSCIOUSNESS": [r"\bconscience\b", r"\binconscient", r"\bcoma\b", r"\bconfusion\b", r"\bsyncope\b", r"\bunconscious\b", r"\bglasgow\b", r"\bgcs\b"],
    "HEMODYNAMIC": [r"\bhypotension\b", r"\bhypertension\b", r"\btension arterielle\b", r"\bblood pressure\b", r"\btachycard", r"\bbradycard", r"\bpouls\b", r"\bpulse\b", r"\bshock\b", r"\bchoc\b"],
    "BLEEDING": [r"\bhemorrag", r"\bsaign", r"\bbleeding\b", r"\bhemorrhag", r"\bhematem", r"\bmelena\b"],
    "TRAUMA": [r"\btrauma", r"\btraumatis", r"\bfracture\b", r"\baccident\b", r"\bchute\b", r"\bfall\b", r"\bhead injury\b"],
    "ACUTE_NEUROLOGICAL": [r"\bavc\b", r"\bstroke\b", r"\bconvulsion", r"\bseizure", r"\bparalys", r"\bdeficit neurolog", r"\bneurological deficit\b"],
    "ACUTE_PAIN": [r"\bdouleur\b", r"\bpain\b", r"\bthorac", r"\bchest pain\b", r"\babdominal pain\b"],
    "VITAL_SIGNS": [r"\btemperature\b", r"\bfievre\b", r"\bfever\b", r"\bfrequence cardiaque\b", r"\bheart rate\b", r"\bfrequence respiratoire\b", r"\brespiratory rate\b", r"\bsaturation\b", r"\bspo2\b"],
    "ACUTE_CONTEXT": [r"\burgence", r"\bemergency\b", r"\baigu", r"\bacute\b", r"\bsoudain", r"\bsudden\b", r"\bbrutal", r"\bdepuis \d+ (minute|minutes|heure|heures|jour|jours)"],
}
RISK = {
    "SELF_HARM_OR_SUICIDE": [r"\bsuicid", r"\bself[- ]harm\b", r"\bautomutil", r"\btentative de suicide\b"],
    "OVERDOSE_OR_POISONING": [r"\boverdose\b", r"\bintoxication\b", r"\bpoison", r"\bsurdosage\b"],
    "SEVERE_BLEEDING": [r"\bhemorrag", r"\bmassive bleeding\b", r"\bsaignement massif\b"],
    "CARDIAC_EMERGENCY": [r"\barret cardiaque\b", r"\bcardiac arrest\b", r"\binfarct", r"\bmyocardial infarction\b"],
    "NEUROLOGICAL_EMERGENCY": [r"\bavc\b", r"\bstroke\b", r"\bstatus epilepticus\b", r"\betat de mal epileptique\b"],
    "SEVERE_RESPIRATORY": [r"\bdetresse respiratoire\b", r"\brespiratory distress\b", r"\basphyx", r"\brespiratory failure\b", r"\binsuffisance respiratoire\b"],
    "PREGNANCY_OBSTETRIC": [r"\bgrossesse\b", r"\bpregnancy\b", r"\beclamps", r"\bpre[- ]eclamps", r"\bhemorragie du post[- ]partum\b"],
    "PEDIATRIC": [r"\bnourrisson\b", r"\binfant\b", r"\bnewborn\b", r"\bnouveau[- ]ne\b", r"\benfant\b", r"\bpediatric\b", r"\bpediatrique\b"],
}
SENSITIVE_HEALTH = {
    "MENTAL_HEALTH": [r"\bdepression\b", r"\bdepressif", r"\bpsychiatr", r"\bschizophren", r"\bpsychos", r"\bbipolar", r"\banxiet", r"\bsuicid", r"\bself[- ]harm\b"],
    "SEXUAL_REPRODUCTIVE_HEALTH": [r"\bgrossesse\b", r"\bpregnancy\b", r"\bcontracept", r"\bsexual", r"\bsexuel", r"\bmenstru", r"\bfertilit", r"\binfertilit", r"\bivg\b", r"\babortion\b"],
    "INFECTIOUS_DISEASE": [r"\bhiv\b", r"\bvih\b", r"\baids\b", r"\bsida\b", r"\bhepatit", r"\btuberculos"],
    "GENETIC_INFORMATION": [r"\bgenetic", r"\bgenetique\b", r"\bmutation\b", r"\bchromosom", r"\bheredit"],
    "ONCOLOGY": [r"\bcancer\b", r"\btumeur\b", r"\btumor\b", r"\bcarcinom", r"\bleukem", r"\blymphom", r"\bmetasta"],
    "SUBSTANCE_USE": [r"\baddiction\b", r"\bdependance\b", r"\btoxicoman", r"\balcool", r"\balcohol", r"\bcocaine\b", r"\bheroin", r"\bcannabis\b", r"\bopioid"],
}
