"""Patterns of clinical concepts and of their negations (letter case never counts)."""

CONCEPTS = {
    "abdominal_pain": [r"\b(?:douleur\s+abdominale|mal\s+au\s+ventre|douleur\s+du\s+ventre)\b", r"\b(?:abdominal\s+pain|stomach\s+pain|belly\s+pain)\b"],
    "amniotic_fluid_loss": [r"\b(?:perte|écoulement|ecoulement)\s+(?:de\s+)?liquide\s+amniotique\b|\brupture\s+de\s+la\s+poche\s+des\s+eaux\b", r"\b(?:amniotic\s+fluid\s+(?:loss|leakage)|rupture\s+of\s+membranes)\b"],
    "anaphylaxis": [r"\b(?:anaphylaxie|choc\s+anaphylactique)\b", r"\b(?:anaphylaxis|anaphylactic\s+shock)\b"],
    "bowel_obstruction_signs": [
        r"\b(?:syndrome|signes?|sympt[oô]mes?)\s+d[’']occlusion\b|\barr[êe]t\s+(?:des\s+)?(?:gaz|matières|matieres|transit)\b",
        r"\b(?:bowel|intestinal)\s+obstruction\b|\bcessation\s+of\s+bowel\s+transit\b",
    ],
    "chemical_burn": [r"\b(?:brûlure|brulure)\s+chimique\b|\bprojection\s+chimique\b", r"\bchemical\s+(?:burn|exposure)\b"],
    "chronic_stable": [r"\b(?:ancien(?:ne)?s?\s+et\s+stables?|chronique\s+stable|stable\s+depuis\s+longtemps)\b", r"\b(?:long-standing\s+and\s+stable|chronic\s+stable|stable\s+for\s+a\s+long\s+time)\b"],
    "complete_postictal_recovery": [
        r"\b(?:récupération|recuperation)\s+complète\s+post(?:-|\s*)critique\b|\brécupération\s+complète\s+après\s+la\s+crise\b",
        r"\bcomplete\s+postictal\s+recovery\b|\bfully\s+recovered\s+after\s+(?:the\s+)?seizure\b",
    ],
    "distal_thrombosis": [r"\b(?:siège|siege|thrombose)\s+distal(?:e)?\b", r"\bdistal\s+(?:location|thrombosis|dvt)\b"],
    "dyspnea_while_speaking": [r"\b(?:dyspnée|dyspnee)\s+(?:à|a)\s+la\s+parole\b|\bincapable\s+de\s+parler\s+en\s+phrases\b", r"\bdyspn(?:ea|oea)\s+while\s+speaking\b|\bunable\s+to\s+speak\s+in\s+full\s+sentences\b"],
    "fever": [r"\b(?:fièvre|fievre|fébrile|febrile|hyperthermie)\b", r"\b(?:fever|febrile|hyperthermia)\b"],
    "first_headache_episode": [r"\b(?:premier|1er)\s+(?:épisode|episode)\s+de\s+(?:céphalée|cephalee)|\bpremière\s+céphalée\b", r"\bfirst\s+(?:episode\s+of\s+)?headache\b|\bfirst-ever\s+headache\b"],
    "head_trauma": [r"\b(?:traumatisme\s+crânien|traumatisme\s+cranien|TC)\b", r"\b(?:head\s+trauma|head\s+injury|traumatic\s+brain\s+injury)\b"],
    "high_velocity_trauma": [r"\b(?:haute|forte)\s+vélocité\b|\btraumatisme\s+à\s+haute\s+énergie\b", r"\b(?:high[- ]velocity|high[- ]energy)\s+trauma\b"],
    "high_voltage": [r"\bhaute\s+tension\b", r"\bhigh\s+voltage\b"],
    "household_current": [r"\b(?:courant|électricité|electricite)\s+domestique\b", r"\bhousehold\s+(?:current|electricity)\b"],
    "hypotonia": [r"\b(?:hypotonie|hypotonique)\b", r"\b(?:hypotonia|hypotonic)\b"],
    "large_abscess": [r"\babcès\s+(?:volumineux|important|étendu)\b", r"\b(?:large|extensive)\s+abscess\b"],
    "lightning_strike": [r"\b(?:foudre|frappé(?:e)?\s+par\s+la\s+foudre)\b", r"\blightning\s+strike\b|\bstruck\s+by\s+lightning\b"],
    "limb_deformity": [r"\b(?:déformation|deformation)\s+(?:du\s+)?membre\b|\bmembre\s+déformé\b", r"\b(?:limb\s+deformity|deformed\s+limb)\b"],
    "low_velocity_trauma": [r"\b(?:faible|basse)\s+vélocité\b", r"\blow[- ]velocity\s+trauma\b"],
    "multiple_seizures": [r"\b(?:crises?|convulsions?)\s+(?:multiples|répétées|récidivantes)\b", r"\b(?:multiple|recurrent|repeated)\s+(?:seizures?|convulsions?)\b"],
    "nasal_flaring": [r"\bbattements?\s+des\s+ailes\s+du\s+nez\b", r"\bnasal\s+flaring\b"],
    "ongoing_seizure": [r"\b(?:crise|convulsion)\s+(?:en\s+cours|persistante)|\bétat\s+de\s+mal\s+épileptique\b", r"\b(?:ongoing\s+seizure|active\s+seizure|status\s+epilepticus)\b"],
    "open_fracture": [r"\bfracture\s+ouverte\b", r"\bopen\s+fracture\b"],
    "paresthesia": [r"\b(?:paresthésie|paresthesie|fourmillements?|engourdissements?)\b", r"\b(?:paresthesia|paresthesias|tingling|numbness)\b"],
    "pregnancy": [r"\b(?:grossesse|enceinte|gestante)\b", r"\b(?:pregnancy|pregnant|gestation)\b"],
    "profuse_diarrhea": [r"\b(?:diarrh[ée]e\s+(?:abondante|profuse|importante)|selles\s+(?:très\s+)?abondantes)\b", r"\b(?:profuse|copious|severe)\s+diarrh(?:ea|oea)\b"],
    "profuse_vomiting": [r"\b(?:vomissements?\s+(?:abondants?|profus|importants?)|vomit\s+abondamment)\b", r"\b(?:profuse|copious|heavy)\s+vomiting\b"],
    "proximal_thrombosis": [r"\b(?:siège|siege|thrombose)\s+proximal(?:e)?\b", r"\bproximal\s+(?:location|thrombosis|dvt)\b"],
    "referred_by_physician": [
        r"\b(?:adressé|adressée|adresse|adressee)\s+(?:aux\s+urgences\s+)?par\s+(?:un|le|son)\s+médecin\b",
        r"\breferred\s+(?:to\s+(?:the\s+)?(?:ED|emergency\s+department)\s+)?by\s+(?:a|the|his|her)\s+physician\b",
    ],
    "resolved_episode": [
        r"\b(?:épisode|episode|sympt[oô]mes?)\s+(?:résolutif|resolutif|résolu|resolu)|\bspontanément\s+résolu\b",
        r"\b(?:resolved\s+episode|symptoms?\s+resolved|spontaneously\s+resolved)\b",
    ],
    "significant_local_signs": [r"\b(?:signes?\s+locaux\s+(?:francs?|importants?)|importants?\s+signes?\s+locaux)\b", r"\b(?:marked|significant)\s+local\s+signs?\b"],
    "snake_or_scorpion_bite": [r"\b(?:morsure\s+de\s+serpent|piqûre\s+de\s+scorpion)\b", r"\b(?:snake\s+bite|scorpion\s+sting)\b"],
    "sudden_headache": [r"\b(?:céphalée|cephalee)s?\s+(?:brutale|soudaine)|\bcéphalée\s+en\s+coup\s+de\s+tonnerre\b", r"\b(?:sudden|thunderclap|abrupt)\s+headache\b"],
    "sudden_hearing_loss": [r"\b(?:surdité|surdite|baisse\s+d[’']audition)\s+(?:brutale|soudaine)\b", r"\bsudden\s+hearing\s+loss\b"],
    "sudden_vision_loss": [r"\b(?:baisse|perte)\s+(?:brutale|soudaine)\s+de\s+(?:la\s+)?vision\b", r"\bsudden\s+(?:vision\s+loss|loss\s+of\s+vision)\b"],
    "vaginal_bleeding": [r"\b(?:métrorragie|metrorragie|saignement\s+vaginal)\b", r"\b(?:vaginal\s+bleeding|metrorrhagia)\b"],
    "violent_behavior": [r"\b(?:comportement\s+violent|violence|violent(?:e)?)\b", r"\b(?:violent\s+behavior|violence|violent)\b"],
    "withdrawal_state": [r"\b(?:état|etat|syndrome)\s+de\s+manque\b|\bsevrage\s+(?:aigu|sévère|severe)\b", r"\b(?:withdrawal\s+state|acute\s+withdrawal|withdrawal\s+syndrome)\b"],
}
NO_CONCEPTS = {
    "fever": [r"\b(?:sans|absence\s+de|pas\s+de)\s+fièvre\b", r"\b(?:afebrile|no\s+fever|without\s+fever)\b"],
    "abdominal_pain": [r"\b(?:sans|absence\s+de|pas\s+de)\s+douleur\s+abdominale\b", r"\b(?:no|without)\s+abdominal\s+pain\b"],
    "multiple_seizures": [r"\b(?:crise\s+unique|épisode\s+unique|episode\s+unique)\b", r"\b(?:single\s+seizure|single\s+episode)\b"],
    "ongoing_seizure": [r"\b(?:crise|convulsion)\s+(?:terminée|terminee|résolue|resolue)|\bplus\s+de\s+convulsions?\b", r"\b(?:seizure\s+resolved|no\s+ongoing\s+seizure)\b"],
    "head_trauma": [r"\b(?:sans|absence\s+de|pas\s+de)\s+traumatisme\s+crânien\b", r"\b(?:no|without)\s+head\s+(?:trauma|injury)\b"],
    "dyspnea_while_speaking": [r"\bparle\s+en\s+phrases\s+complètes\b", r"\bspeaks?\s+in\s+full\s+sentences\b"],
    "nasal_flaring": [r"\b(?:sans|absence\s+de|pas\s+de)\s+battements?\s+des\s+ailes\s+du\s+nez\b", r"\bno\s+nasal\s+flaring\b"],
    "pregnancy": [r"\b(?:non\s+enceinte|grossesse\s+exclue|test\s+de\s+grossesse\s+négatif)\b", r"\b(?:not\s+pregnant|pregnancy\s+excluded|negative\s+pregnancy\s+test)\b"],
    "vaginal_bleeding": [r"\b(?:sans|absence\s+de|pas\s+de)\s+(?:métrorragie|metrorragie|saignement\s+vaginal)\b", r"\b(?:no|without)\s+vaginal\s+bleeding\b"],
    "amniotic_fluid_loss": [r"\b(?:sans|absence\s+de|pas\s+de)\s+perte\s+de\s+liquide\s+amniotique\b", r"\b(?:no|without)\s+amniotic\s+fluid\s+(?:loss|leakage)\b"],
    "hypotonia": [r"\b(?:sans|absence\s+de|pas\s+d[’']?)\s*hypotonie\b", r"\b(?:no|without)\s+hypotonia\b"],
    "paresthesia": [r"\b(?:sans|absence\s+de|pas\s+de)\s+paresthésies?\b", r"\b(?:no|without)\s+paresthesias?\b"],
    "referred_by_physician": [r"\b(?:non\s+adressé|non\s+adressee|vient\s+de\s+lui-même)\b", r"\b(?:self-referred|not\s+referred\s+by\s+a\s+physician)\b"],
    "anaphylaxis": [r"\b(?:sans|absence\s+d[’']?|pas\s+d[’']?)\s*anaphylaxie\b", r"\b(?:no|without)\s+anaphylaxis\b"],
    "significant_local_signs": [r"\b(?:sans|absence\s+de|pas\s+de)\s+signes?\s+locaux\s+importants?\b", r"\b(?:no|without)\s+significant\s+local\s+signs?\b"],
    "limb_deformity": [r"\b(?:sans|absence\s+de|pas\s+de)\s+déformation\s+(?:du\s+)?membre\b", r"\b(?:no|without)\s+limb\s+deformity\b"],
    "open_fracture": [r"\b(?:sans|absence\s+de|pas\s+de)\s+fracture\s+ouverte\b", r"\b(?:no|without)\s+open\s+fracture\b"],
}
