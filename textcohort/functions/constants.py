"""Fixed values that results depend on."""

#: Placeholders that count as a missing text, in the two rules.
MISSING_A = ["nan", "none", "null", "na", "n/a", "missing", "<na>", "not available", "not applicable"]
MISSING_B = ["", "na", "n/a", "nan", "none", "null", "missing", "not available", "not applicable", "[missing]", "no mri", "no report"]

#: Cues of negation and of uncertainty.
NEGATION = [r"\bno\b", r"\bnot\b", r"\bwithout\b", r"\babsent\b", r"\bnegative for\b", r"\bfree of\b", r"\bneither\b", r"\bnone\b", r"\bresolved\b", r"\bresolution of\b"]
UNCERTAINTY = [r"\bpossible\b", r"\bpossibly\b", r"\bprobable\b", r"\blikely\b", r"\bsuspicious\b", r"\bsuspected\b", r"\bcannot exclude\b", r"\bmay represent\b", r"\bindeterminate\b", r"\buncertain\b", r"\bfavored\b", r"\bprobably\b", r"\bpresumably\b"]

#: Words that are no evidence terms.
STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with", "is", "are", "was", "were", "by", "at", "from", "as", "this", "that", "it",
    "be", "has", "have", "had", "but", "not", "no", "into", "than", "then", "there", "their", "its", "also", "may", "can", "which", "within",
    "without", "after", "before", "left", "right", "breast", "tumor", "carcinoma", "report", "reports", "provided", "tier",
]

#: Flags of report structure: name and pattern over normalised text.
SECTION_FLAGS = {
    "has_findings_section": r"\bfindings\b",
    "has_impression_section": r"\bimpression\b",
    "has_comparison_section": r"\bcomparison\b|\bcompared with\b|\bprior\b",
    "has_response_language": r"\bresponse\b|\bdecreased\b|\bresolved\b|\bpersistent\b|\bresidual\b",
    "has_measurement_language": r"\b\d+(?:\.\d+)?\s*(?:cm|mm)\b",
}
SECTION_FLAGS_PATHOLOGY = {
    "has_findings_section": r"\bfindings\b",
    "has_impression_section": r"\bimpression\b",
    "has_comparison_section": r"\bcomparison\b|\bcompared with\b|\bprior\b|\bprevious\b",
    "has_response_language": r"\bresponse\b|\bdecreased\b|\bresolved\b|\bpersistent\b|\bresidual\b|\btreatment effect\b|\btherapy effect\b|\bnear complete\b|\bcomplete response\b|\bpartial response\b|\bviable tumor\b|\btumor bed\b",
    "has_measurement_language": r"\b\d+(?:\.\d+)?\s*(?:cm|mm)\b",
    "has_final_diagnosis_section": r"\bfinal diagnosis\b|\bdiagnosis\b",
    "has_synoptic_section": r"\bsynoptic\b|\bcase summary\b|\bcancer case summary\b",
    "has_gross_description_section": r"\bgross description\b|\bgross\b",
    "has_microscopic_section": r"\bmicroscopic\b|\bmicroscopy\b",
    "has_margin_language": r"\bmargin\b|\bmargins\b|\binked\b|\btransected\b",
    "has_lymph_node_language": r"\blymph node\b|\blymph nodes\b|\bnode-positive\b|\bnode negative\b|\bsentinel\b",
}

#: The shared concepts: category and patterns, in the order in which a concept is inferred.
ONTOLOGY = {
    "extent_span": ("spatial_morphology_response", [r"\bextent\b", r"\bspan\b", r"\bspanning\b", r"\bmeasur", r"\blarge area\b", r"\bbroad\b", r"\bdiffuse\b", r"\bextensive\b", r"\bcm\b", r"\bmm\b"]),
    "multiplicity": ("spatial_morphology_response", [r"\bmultifocal\b", r"\bmultiple\b", r"\bseveral\b", r"\bsatellite", r"\badditional foci\b", r"\bseparate foci\b", r"\bsmall foci\b"]),
    "multicentricity_separate_sites": ("spatial_morphology_response", [r"\bmulticentric\b", r"\bseparate sites\b", r"\bseparate areas\b", r"\bwidely separated\b", r"\bseparated by\b", r"\bdifferent quadrant"]),
    "distribution_linear_segmental_regional": ("spatial_morphology_response", [r"\bsegmental\b", r"\blinear\b", r"\bregional\b", r"\bductal distribution\b", r"\bclumped\b", r"\bgeographic\b"]),
    "fragmentation_scattered_patchy_discontinuous": ("spatial_morphology_response", [r"\bdiscontinuous\b", r"\bdiscontinuity\b", r"\bpatchy\b", r"\bskip\b", r"\bscattered\b", r"\bfragment", r"\bintermixed\b"]),
    "residual_tumor_presence": ("residual_disease", [r"\bresidual\b", r"\bpersistent\b", r"\bviable carcinoma\b", r"\bresidual carcinoma\b", r"\bresidual disease\b", r"\bremaining\b"]),
    "non_mass_enhancement": ("spatial_morphology_response", [r"\bnon[- ]mass enhancement\b", r"\bnme\b", r"\bnon mass\b"]),
    "invasive_disease": ("pathology_specific", [r"\binvasive\b", r"\binvasion\b", r"\binfiltrating carcinoma\b"]),
    "in_situ_disease_dcis": ("pathology_specific", [r"\bdcis\b", r"\bductal carcinoma in situ\b", r"\bin situ\b", r"\bintraductal\b"]),
    "treatment_response": ("spatial_morphology_response", [r"\bdecrease\b", r"\bdecreased\b", r"\binterval decrease\b", r"\bshrink", r"\breduced\b", r"\bsmaller\b", r"\bresponse\b", r"\bcomplete response\b", r"\bnear complete\b", r"\bpartial response\b"]),
    "treatment_effect_tumor_bed": ("response_treatment_effect", [r"\btreatment effect\b", r"\btumou?r bed\b", r"\bfibrosis\b", r"\btherapy[- ]related\b", r"\bpost[- ]treatment\b", r"\bcellularity\b"]),
    "localized_compact_residual": ("spatial_morphology_response", [r"\blocalized\b", r"\bcompact\b", r"\bsingle\b", r"\bsolitary\b", r"\bdominant mass\b", r"\bfocal\b", r"\bsingle residual\b", r"\bone focus\b"]),
    "diffuse_scattered_residual": ("spatial_morphology_response", [r"\bdiffuse residual\b", r"\bpatchy residual\b", r"\bscattered residual\b", r"\bmultiple residual\b", r"\bdiscontinuous residual\b", r"\bwidely distributed\b"]),
    "lymphovascular_invasion": ("pathology_specific", [r"\blymphovascular invasion\b", r"\blvi\b"]),
    "margin_proximity": ("pathology_specific", [r"\bmargin\b", r"\bmm from\b", r"\bclose margin\b", r"\bpositive margin\b", r"\bclear margin\b"]),
    "benign_or_nonspecific_enhancement": ("ambiguity_noise", [r"\bnonspecific\b", r"\bprobably benign\b", r"\bfavored benign\b", r"\bbackground parenchymal enhancement\b", r"\bbpe\b", r"\bbenign enhancement\b"]),
}
DEFAULT_CONCEPT = "other_candidate_feature"
SPATIAL_CATEGORIES = ["spatial_morphology_response", "residual_disease", "response_treatment_effect"]
DISTRIBUTION = ["multiplicity", "multicentricity_separate_sites", "distribution_linear_segmental_regional", "fragmentation_scattered_patchy_discontinuous", "diffuse_scattered_residual", "non_mass_enhancement"]
AMBIGUITY = ["benign_or_nonspecific_enhancement"]

#: Prices per million tokens: fresh input, cached input, output.
PRICES = {"small": (0.05, 0.01, 0.40), "large": (1.25, 0.13, 10.00)}
HIGH_SCORE = 85.0
