"""Settings: defaults, overlays and validation, read on the driver."""

from __future__ import annotations

import copy
from pathlib import Path
from typing import Any

# Label taxonomy, anchors (metric, good, bad) and thresholds that results depend on.
LABELS = ("blur", "glare", "shadow", "skew", "cropped", "low_resolution", "low_contrast", "noise", "streaks", "unreadable")
LOCAL_LABELS = ("glare", "shadow", "cropped", "streaks")
AUTO_LABELS = ("unreadable",)
SPLIT_PARTS = ("train", "val", "test")

DEFAULTS: dict[str, Any] = {
    "labels": list(LABELS),
    "local": list(LOCAL_LABELS),
    "auto_labels": list(AUTO_LABELS),
    "patch_size": 384, "target_dpi": 300, "dpi_fallback": "a4", "allow_upscale": False,
    "grid": {"rows": 9, "cols": 6},
    "scores": {
        "blur": {"metric": "tenengrad_norm", "good": 0.988, "bad": 0.459},
        "shadow": {"metric": "shadow_frac", "good": 0.0, "bad": 0.064},
        "skew": {"metric": "skew_abs_deg", "good": 0.0, "bad": 1.555},
        "cropped": {"metric": "border_ink_frac", "good": 0.0, "bad": 0.621},
        "low_resolution": {"metric": "line_height_px", "good": 30.0, "bad": 13.0},
        "streaks": {"metric": "streak_energy", "good": 0.0, "bad": 0.078},
        "glare": {"metric": "glare_cluster_frac", "good": 0.0, "bad": 0.04},
        "low_contrast": {"metric": "ink_paper_gap", "good": 110.0, "bad": 30.0},
        "noise": {"metric": "noise_sigma", "good": 2.0, "bad": 12.0},
    },
    "cv": {
        "glare_threshold": 245, "glare_min_cluster_frac": 0.0005, "glare_flat_window_frac": 0.02, "glare_flat_std": 3.0, "glare_min_excess": 8,
        "ink_block_frac": 0.03, "ink_offset": 10, "ink_denoise_frac": 0.0015, "crop_band_frac": 0.005, "crop_frame_span_frac": 0.8,
        "bitonal_mid_low": 40, "bitonal_mid_high": 215, "bitonal_max_mid_frac": 0.05, "shadow_rel_threshold": 0.82, "shadow_background_frac": 0.06,
        "skew_max_angle": 15.0, "skew_coarse_step": 1.0, "skew_fine_step": 0.1, "skew_work_height": 800, "min_ink_frac": 0.01,
        "line_min_row_ink_frac": 0.02, "line_max_height_frac": 0.25, "line_profile_smooth_frac": 0.002, "streak_smooth_frac": 0.02,
    },
    "ocr": {
        "languages": ["en"], "work_side": 1600, "min_confidence": 0.30, "min_boxes": 5, "unreadable_threshold": 0.5,
        "extra_chars": "0123456789.,;:!?()[]{}-–—«»\"'/\\%№@#&*+=<>_$ \t\n",
        "unreadable": {"mean_confidence": {"good": 0.85, "bad": 0.35}, "garbage_ratio": {"good": 0.05, "bad": 0.40}, "nonword_ratio": {"good": 0.15, "bad": 0.50}},
    },
    "labeling": {"suggest_threshold": 0.30, "sample_total": 300, "random_share": 0.5, "sample_seed": 42},
    "split": {"ratios": {"train": 0.2, "val": 0.3, "test": 0.5}, "seed": 42, "document_id": "bates7"},
    "synth": {
        "seed": 42, "target_total": 8000, "max_defects_per_image": 3, "min_label_share": 0.15, "base_probability": 0.22, "severity": {"min": 0.3, "max": 1.0},
        "reference": {"max_defect_score": 0.25, "count": 900},
        "params": {
            "blur_gauss": {"ksize": [3, 21]}, "blur_motion": {"length": [5, 31]}, "glare": {"radius_frac": [0.06, 0.26], "softness_frac": [0.2, 0.5]},
            "shadow": {"depth": [0.2, 0.6], "width_frac": [0.12, 0.45]}, "skew": {"angle_deg": [1.0, 7.0]}, "cropped": {"cut_frac": [0.03, 0.16]},
            "low_resolution": {"scale": [0.6, 0.22]}, "low_contrast": {"factor": [0.7, 0.15]}, "noise": {"sigma": [4.0, 24.0], "salt_prob": [0.0, 0.012]},
            "streaks": {"count": [3, 14], "depth": [18, 70], "width": [1, 4]},
        },
    },
    "dataset": {"patches_per_page": 4, "min_ink_frac": 0.01, "min_mask_overlap": 0.15, "max_patch_attempts": 12, "brightness": 0.12, "contrast": 0.12},
    "train": {"pos_weight": "auto", "pos_weight_max": 50.0},
    "verdict": {"tau_low": 0.30, "tau_high": 0.60, "tau_unreadable": 0.50},
}


def deep_merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Maps merge key by key, everything else is replaced whole; base stays as it is."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def read_yaml(path: str | Path) -> dict[str, Any]:
    import yaml

    if not Path(path).is_file():
        raise FileNotFoundError(path)
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8-sig"))
    if not isinstance(data, dict):
        raise ValueError(f"{path}: the root isn't a mapping")
    return data


def load(*overlays: str | Path | dict[str, Any]) -> dict[str, Any]:
    """The defaults under overlays (files or mappings), in order, validated."""
    out = copy.deepcopy(DEFAULTS)
    for x in overlays:
        out = deep_merge(out, x if isinstance(x, dict) else read_yaml(x))
    validate(out)
    return out


def _unknown(given: dict[str, Any], known: dict[str, Any], where: str, errors: list[str]) -> None:
    for key in given:
        if key not in known and where not in ("scores", "params"):
            errors.append(f"unknown setting {where}.{key}" if where else f"unknown setting {key}")
        elif isinstance(given[key], dict) and isinstance(known.get(key), dict):
            _unknown(given[key], known[key], key, errors)


def validate(c: dict[str, Any]) -> None:
    """Raises ValueError with everything that is wrong."""
    e: list[str] = []
    _unknown(c, DEFAULTS, "", e)
    labels, local, auto = c["labels"], c["local"], c["auto_labels"]
    if len(set(labels)) != len(labels):
        e.append("labels repeat")
    if not set(local) <= set(labels):
        e.append("local labels aren't all labels")
    if not set(auto) <= set(labels):
        e.append("automatic labels aren't all labels")
    if not set(c["scores"]) <= set(labels):
        e.append("scores name other labels")
    for name, a in {**c["scores"], **c["ocr"]["unreadable"]}.items():
        if a["good"] == a["bad"]:
            e.append(f"anchors of {name} are equal")
    if set(c["ocr"]["unreadable"]) != {"mean_confidence", "garbage_ratio", "nonword_ratio"}:
        e.append("unreadable needs exactly its three signals")
    if c["cv"]["skew_fine_step"] > c["cv"]["skew_coarse_step"]:
        e.append("the fine skew step is over the coarse one")
    if c["cv"]["bitonal_mid_low"] >= c["cv"]["bitonal_mid_high"]:
        e.append("bitonal bounds are out of order")
    ratios = c["split"]["ratios"]
    if set(ratios) != set(SPLIT_PARTS) or min(ratios.values()) <= 0 or abs(sum(ratios.values()) - 1) > 1e-6:
        e.append("split ratios must be positive, for train, val and test, and sum to 1")
    if c["split"]["document_id"] not in ("bates7", "stem", "parent"):
        e.append("unknown document_id")
    if c["synth"]["severity"]["min"] > c["synth"]["severity"]["max"]:
        e.append("severity bounds are out of order")
    for name, params in c["synth"]["params"].items():
        for key, pair in params.items():
            if len(pair) != 2 or pair[0] == pair[1]:
                e.append(f"{name}.{key} needs two different bounds")
    if c["train"]["pos_weight"] != "auto" and not isinstance(c["train"]["pos_weight"], list):
        e.append("pos_weight is auto or a list")
    if c["verdict"]["tau_low"] >= c["verdict"]["tau_high"]:
        e.append("verdict thresholds are out of order")
    if e:
        raise ValueError("; ".join(e))


def manual_labels(c: dict[str, Any]) -> list[str]:
    return [x for x in c["labels"] if x not in c["auto_labels"]]
