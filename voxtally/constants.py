"""Fixed domains shared by every operator.

Fixed values: label codes, region names, thresholds, precisions and text formats
in this file have to equal the published ones for results to agree.
"""

# Label codes of a hard segmentation.
BACKGROUND, NCR, ED, ET = 0, 1, 2, 4
CLASS_CODES = {"NCR": NCR, "ED": ED, "ET": ET}

# Nested compartments, outermost first, and the codes each one covers.
COMPARTMENTS = ("WT", "TC", "ET")
COMPARTMENT_CODES = {"WT": (NCR, ED, ET), "TC": (NCR, ET), "ET": (ET,)}
DISJOINT = ("NCR", "ED", "ET")

# Channel order of the probability volumes when a sidecar names none.
PROBABILITY_CHANNELS = ("TC", "WT", "ET")

# Comparator code -> label code.
COMPARATOR_REMAP = {
    "hdglio": {1: ED, 2: ET},
    "dbt": {1: ET, 2: NCR, 3: ED},
}

# Comparator codes that make up each compartment it resolves.
COMPARATOR_COMPARTMENTS = {
    "hdglio": {"WT": (1, 2), "ET": (2,)},
    "deepbratumia": {"WT": (1, 2, 3), "TC": (1, 2), "ET": (1,)},
}

# Two-stage segmenter codes.
WHOLE_TUMOR_CODE = 18
INNER_NCR_CODES, INNER_ED_CODES, INNER_ET_CODES = (3,), (1,), (2,)
RAW_CODES = (1, 2, 3)

# Lobes in display order.
LOBES = (
    "frontal",
    "cingulate",
    "insula",
    "parietal",
    "temporal",
    "occipital",
    "subcortical-deep",
    "subcortical-limbic",
    "cerebellum",
    "brainstem",
    "other",
)

# Desikan-Killiany cortical stems by lobe.
CORTICAL_STEMS = {
    "frontal": (
        "superiorfrontal",
        "rostralmiddlefrontal",
        "caudalmiddlefrontal",
        "parsopercularis",
        "parstriangularis",
        "parsorbitalis",
        "lateralorbitofrontal",
        "medialorbitofrontal",
        "precentral",
        "paracentral",
        "frontalpole",
    ),
    "cingulate": (
        "rostralanteriorcingulate",
        "caudalanteriorcingulate",
        "posteriorcingulate",
        "isthmuscingulate",
    ),
    "insula": ("insula",),
    "parietal": (
        "superiorparietal",
        "inferiorparietal",
        "supramarginal",
        "postcentral",
        "precuneus",
    ),
    "temporal": (
        "superiortemporal",
        "middletemporal",
        "inferiortemporal",
        "bankssts",
        "fusiform",
        "transversetemporal",
        "entorhinal",
        "temporalpole",
        "parahippocampal",
    ),
    "occipital": ("lateraloccipital", "lingual", "cuneus", "pericalcarine"),
}

# Subcortical names, without hemisphere prefix, by lobe.
SUBCORTICAL_NAMES = {
    "subcortical-deep": (
        "Thalamus",
        "Caudate",
        "Putamen",
        "Pallidum",
        "Accumbens-area",
        "VentralDC",
    ),
    "subcortical-limbic": ("Hippocampus", "Amygdala"),
    "cerebellum": ("Cerebellum-Cortex", "Cerebellum-White-Matter"),
    "brainstem": ("Brain-Stem",),
}

# Names that belong to no lobe.
UNMAPPED_NAMES = (
    "Unknown",
    "CSF",
    "Lateral-Ventricle",
    "Inf-Lat-Vent",
    "3rd-Ventricle",
    "4th-Ventricle",
    "5th-Ventricle",
    "choroid-plexus",
    "Choroid-Plexus",
    "UnsegmentedWhiteMatter",
    "WM-hypointensities",
    "non-WM-hypointensities",
    "Optic-Chiasm",
    "CC_Anterior",
    "CC_Central",
    "CC_Mid_Anterior",
    "CC_Mid_Posterior",
    "CC_Posterior",
)

# Functional-adjacency groups: (group id, label, hemisphere or None, stems).
FUNCTIONAL_GROUPS = (
    (
        "functional:motor_adjacent",
        "motor-adjacent",
        None,
        ("precentral", "postcentral", "paracentral", "supramarginal"),
    ),
    (
        "functional:left_language_adjacent",
        "left language-adjacent",
        "L",
        (
            "parsopercularis",
            "parstriangularis",
            "superiortemporal",
            "middletemporal",
            "bankssts",
            "supramarginal",
        ),
    ),
    (
        "functional:deep_midline_commissural",
        "deep-midline / commissural",
        None,
        (
            "Thalamus",
            "Caudate",
            "Putamen",
            "Pallidum",
            "Accumbens-area",
            "VentralDC",
            "CC_Anterior",
            "CC_Central",
            "CC_Mid_Anterior",
            "CC_Mid_Posterior",
            "CC_Posterior",
        ),
    ),
)

# Paired metrics and the decimals they are printed with.
METRIC_DECIMALS = {
    "dice": 3,
    "hd95_mm": 2,
    "abs_volumetric_error_mm3": 0,
    "sensitivity": 3,
    "specificity": 3,
}
METRICS = tuple(METRIC_DECIMALS)
SIDECAR_VERSIONS = ("1.0",)

# Acceptance floors for Dice and the surface-distance ceiling in mm.
DICE_FLOOR = {"WT": 0.85, "TC": 0.75, "ET": 0.70}
HD95_CEILING_MM = 20.0

# Limits-of-agreement multiplier.
LOA_MULTIPLIER = 1.96

# Required columns of a region table on disk.
REGION_TABLE_COLUMNS = (
    "label",
    "name",
    "compartment",
    "parcel_voxels",
    "overlap_voxels",
    "overlap_volume_mm3",
    "pct_of_parcel",
)

# Subject-id formats.
BASELINE_ID_PATTERN = r"^UCSF-PDGM-(\d+)$"
LISTING_ID_PATTERN = r"UCSF-PDGM-(\d{4})_nifti"
SUBJECT_ID_PATTERN = r"^[0-9]{4}$"
GROWN_SUBJECT_ID_PATTERN = r"^[0-9]{4,}$"

# Stratified draw, subjects per (sex, survival tertile).
ALLOCATION = {
    ("M", "short"): 10,
    ("M", "mid"): 10,
    ("M", "long"): 10,
    ("F", "short"): 7,
    ("F", "mid"): 7,
    ("F", "long"): 6,
}
TERTILES = ("short", "mid", "long")

# Columns and accepted values of the eligibility filter.
ELIGIBLE = {
    "Final pathologic diagnosis (WHO 2021)": "Glioblastoma, IDH-wildtype",
    "WHO CNS Grade": "4",
    "IDH": "wildtype",
    "Biopsy prior to imaging": "No",
}
SPLIT_COLUMN, EXCLUDED_SPLIT = "BraTS21 Segmentation Cohort", "Training"

# Clinical header columns, all read as text.
METADATA_COLUMNS = (
    "ID",
    "Sex",
    "Age at MRI",
    "WHO CNS Grade",
    "Final pathologic diagnosis (WHO 2021)",
    "MGMT status",
    "IDH",
    "1-dead 0-alive",
    "OS",
    "EOR",
    "Biopsy prior to imaging",
    "BraTS21 Segmentation Cohort",
)

# Response codes, compared without case.
PRE_OP, POST_OP, PROGRESSION = "pre-op", "post-op", "pd"

# Imaging channels of a follow-up study.
FOLLOW_UP_CHANNELS = ("T1", "CT1", "T2", "FLAIR")

# How the titles of a rating table begin; the rationale is looked for first.
RATING_TITLES = {
    "patient_id": "patient",
    "timepoint": "date",
    "rano_rationale": ".*rationale",
    "rano": "rating( |$)",
    "line": "line$",
}
