"""Names, codes, wording and limits that results depend on."""

# --- Fixed values: enumerations -------------------------------------------------
SOURCES = ("sim", "teleop_sim", "teleop_real", "autonomous_real", "mixed")
PHYSICAL_SOURCES = ("teleop_real", "autonomous_real")
LAYOUTS = ("chunked", "per_episode")
RESULTS = ("pass", "fail", "inconclusive")

# --- Fixed values: check ids and result codes -----------------------------------
CHECK_IDS = {
    "dedup.v1": 1,
    "timing.v1": 2,
    "kinematics.v1": 3,
    "sensor_consistency.v1": 4,
    "sim_signature.v1": 5,
    "attestation.v1": 6,
    "task_compliance.v1": 7,
}
RESULT_CODES = {"fail": 0, "pass": 1, "inconclusive": 2}

# --- Fixed values: default check settings ---------------------------------------
CHECK_SETTINGS = {
    "dedup.v1": {"enabled": True, "blocking": False, "emit_fail": False},
    "timing.v1": {"enabled": True, "blocking": True, "emit_fail": True},
    "kinematics.v1": {"enabled": True, "blocking": True, "emit_fail": True},
    "sensor_consistency.v1": {"enabled": True, "blocking": False, "emit_fail": False},
    "sim_signature.v1": {"enabled": True, "blocking": False, "emit_fail": False},
}

# --- Fixed values: keys of the closed manifest shapes ----------------------------
CAPTURE_SHAPE = {
    "v": None, "kind": None, "org_id": None, "dataset_id": None, "source": None, "layout": None, "embodiment": None, "rate_hz": None,
    "duration_ms": None, "captured_at": None, "channels": [{"name": None, "dtype": None, "shape": None, "hz": None, "unit": None}],
    "files": [{"path": None, "bytes": None, "hash": None}], "range": {"episode_index": None, "frames": None, "video": "free"},
    "payload_hash": None, "consent_commitment": None, "terms_hash": None, "scope_bits": None, "task": {"instruction": None, "task_id": None},
    "outcome": {"success": None}, "sim": {"task_spec_hash": None, "world_seed": None}, "signature": {"alg": None, "key_id": None, "sig": None},
}
CORPUS_SHAPE = {
    "v": None, "kind": None, "org_id": None, "title": None, "episodes": None, "corpus_root": None, "episode_count": None, "terms_hash": None,
    "task_id": None, "sources": None, "filters": {"min_badges": None, "exclude_failed_checks": None}, "sealed_at": None,
}

# --- Fixed values: thresholds that a claim's detail names -------------------------
CHECK_THRESHOLDS = {
    "timing.v1": {"period_tolerance_fraction": 0.25, "min_within_tolerance_fraction": 0.99, "max_gap_fraction": 5, "frame_count_tolerance": 2},
    "kinematics.v1": {"joint_limit_tolerance_deg": 1, "max_accel_rad_s2": 50},
    "dedup.v1": {"T_exact": 0.02, "T_near": 0.05},
    "sensor_consistency.v1": {"rho_pass": 0.4, "rho_fail": 0.2},
    "sim_signature.v1": {"score_inconclusive": 2, "score_fail": 3},
}

# --- Fixed values: words no surface may show ------------------------------------
FORBIDDEN_WORDS = ("authentic", "genuine", "real", "proven real", "verified", "independent")

# --- Fixed values: wording templates --------------------------------------------
COMMITTED_TEXT = (
    "Committed — existed by block %s on %s; log unchanged since; consent %s as of anchor (size %s)."
)
REVOKED_TEXT = "revoked at block %s"
SIGNED_TEXT = "Signed — %s signed this record before it was logged; unchanged since."
ATTESTED_TEXT = (
    "Attested — signing key held in hardware attested by %s (%s); this proves which device signed, "
    "not what its sensors saw."
)
CHECKED_TEXT = "Checked by %s — %s checks run: %s. Heuristic; see details."
PENDING_TEXT = "Pending — received, not yet anchored."
CHECK_FAILED_TEXT = "Check %s failed: %s."
NO_SUMMARY_TEXT = "no summary provided"
SOURCE_TEXT = {
    "sim": "simulation",
    "teleop_sim": "human-driven simulation",
    "teleop_real": "human-driven physical robot",
    "autonomous_real": "autonomous physical robot",
    "mixed": "mixed",
}
DECLARED_SOURCE_TEXT = "Source — declared by the signer: %s. Not attested."
ATTESTED_SOURCE_TEXT = (
    "Source — attested physical capture: controller key attested by %s (%s); "
    "simulation-signature check passed."
)
SOURCES_SUMMARY_TEXT = "Sources — %s; %s of %s episodes declared physical, %s attested."

# --- Fixed values: task specification vocabulary --------------------------------
ACTION_SPACES = ("ee_pose_gripper", "joint_position", "base_velocity", "whole_body_retarget")
PREDICATES = ("on", "in", "upright_on", "within", "grasped", "released", "settled", "near")
HIGH_DOF_EMBODIMENTS = (
    "unitree_g1", "unitree_h1", "apptronik_apollo", "booster_t1", "fourier_n1",
    "pal_talos", "berkeley_humanoid", "robotis_op3", "pnd_adam_lite",
    "toddlerbot_2xc", "toddlerbot_2xm", "shadow_hand", "shadow_dex_ee", "allegro_hand",
)
PILOT_EPISODES = 50

# --- Fixed values: record layouts, (field, bytes) -------------------------------
CAPTURE_LAYOUT = (
    ("version", 1), ("payload_hash", 32), ("manifest_hash", 32), ("consent_commitment", 32),
    ("terms_id", 32), ("captured_at", 8), ("submitted_at", 8), ("duration_ms", 4),
    ("scope_bits", 4), ("channels", 1),
)
EPISODE_LAYOUT = (
    ("version", 1), ("payload_hash", 32), ("manifest_hash", 32), ("consent_commitment", 32),
    ("terms_id", 32), ("task_id", 32), ("captured_at", 8), ("submitted_at", 8),
    ("duration_ms", 4), ("scope_bits", 4), ("channels", 1), ("world_seed", 8),
    ("success_flag", 1), ("quality_score", 2),
)
CORPUS_LAYOUT = (
    ("version", 1), ("corpus_manifest_hash", 32), ("corpus_root", 32), ("terms_hash", 32),
    ("task_id", 32), ("episode_count", 8), ("sealed_at", 8),
)
CLAIM_LAYOUT = (
    ("version", 1), ("subject_leaf", 32), ("verifier_key_id", 32), ("detail_hash", 32),
    ("signature_hash", 32), ("check_id", 2), ("result", 1), ("level_asserted", 1), ("issued_at", 8),
)
RECORD_KINDS = {
    1: ("capture", CAPTURE_LAYOUT),
    2: ("episode", EPISODE_LAYOUT),
    3: ("corpus", CORPUS_LAYOUT),
    4: ("claim", CLAIM_LAYOUT),
}

# --- Fixed values: check constants ----------------------------------------------
TIMING_PERIOD_TOLERANCE = 0.25
TIMING_MIN_WITHIN = 0.99
TIMING_MAX_GAP = 5
TIMING_COUNT_TOLERANCE = 2
JOINT_TOLERANCE_DEG = 1
MAX_ACCELERATION = 50
RESAMPLE_HZ = 10
MIN_TRAJECTORY_S = 1
WARP_BAND = 0.1
EXACT_DISTANCE = 0.02
NEAR_DISTANCE = 0.05
LSH_TABLES = 8
LSH_PLANES = 16
HISTOGRAM_BINS = 32
DCT_TERMS = 8
MOTION_HZ = 5
CORRELATION_PASS = 0.4
CORRELATION_FAIL = 0.2
REPEAT_FRACTION_MAX = 0.05
DT_VARIANCE_MIN = 1e-12
SPECTRAL_HZ = 20
SPECTRAL_CUTOFF_HZ = 5
SPECTRAL_SHARE_MIN = 1e-6
ZERO_MOTION_MIN = 0.2
SCORE_INCONCLUSIVE = 2
SCORE_FAIL = 3

# --- Fixed values: anchors and fees ---------------------------------------------
ANCHOR_INTERVAL_S = {"primary": 3600, "mirror": 86400}
RETRY_BACKOFF_S = (30, 60, 120, 240, 300)
PROTOCOL_FEE_BPS = 250
PAGE_DEFAULT = 50
PAGE_MAX = 500
RECENT_ANCHORS = 12
BURST_CAPACITY = 60
BURST_REFILL_S = 60
IDEMPOTENCY_TTL_S = 86400

# --- Fixed values: machine types: id, name, vendor, class, dof, licence, trademark check ---
EMBODIMENTS = (
    ("unitree_g1", "G1", "Unitree", "humanoid", 43, "BSD-3-Clause", False),
    ("unitree_h1", "H1", "Unitree", "humanoid", 19, "BSD-3-Clause", False),
    ("apptronik_apollo", "Apollo", "Apptronik", "humanoid", 30, "Apache-2.0", False),
    ("booster_t1", "T1", "Booster Robotics", "humanoid", 23, "Apache-2.0", False),
    ("fourier_n1", "N1", "Fourier", "humanoid", 23, "Apache-2.0", False),
    ("pal_talos", "TALOS", "PAL Robotics", "humanoid", 32, "Apache-2.0", False),
    ("berkeley_humanoid", "Berkeley Humanoid", "UC Berkeley", "humanoid", 12, "BSD-3-Clause", False),
    ("robotis_op3", "OP3", "Robotis", "humanoid", 20, "Apache-2.0", False),
    ("pnd_adam_lite", "Adam Lite", "PNDbotics", "humanoid", 25, "MIT", False),
    ("toddlerbot_2xc", "ToddlerBot 2XC", "Stanford", "humanoid", 30, "MIT", False),
    ("toddlerbot_2xm", "ToddlerBot 2XM", "Stanford", "humanoid", 30, "MIT", False),
    ("agility_cassie", "Cassie", "Agility Robotics", "biped", 10, "MIT", False),
    ("unitree_go2", "Go2", "Unitree", "quadruped", 12, "BSD-3-Clause", False),
    ("unitree_go1", "Go1", "Unitree", "quadruped", 12, "BSD-3-Clause", False),
    ("unitree_a1", "A1", "Unitree", "quadruped", 12, "BSD-3-Clause", False),
    ("anymal_b", "ANYmal B", "ANYbotics", "quadruped", 12, "BSD-3-Clause", False),
    ("anymal_c", "ANYmal C", "ANYbotics", "quadruped", 12, "BSD-3-Clause", False),
    ("bd_spot", "Spot", "Boston Dynamics", "quadruped", 12, "BSD-3-Clause", True),
    ("barkour_v0", "Barkour v0", "Google", "quadruped", 12, "Apache-2.0", False),
    ("barkour_vb", "Barkour vB", "Google", "quadruped", 12, "Apache-2.0", False),
    ("franka_panda", "Panda", "Franka Emika", "arm", 7, "Apache-2.0", False),
    ("franka_fr3", "FR3", "Franka Robotics", "arm", 7, "Apache-2.0", False),
    ("ur5e", "UR5e", "Universal Robots", "arm", 6, "BSD-3-Clause", True),
    ("ur10e", "UR10e", "Universal Robots", "arm", 6, "BSD-3-Clause", True),
    ("kuka_iiwa14", "LBR iiwa 14", "KUKA", "arm", 7, "BSD-3-Clause", True),
    ("kinova_gen3", "Gen3", "Kinova", "arm", 7, "BSD-3-Clause", False),
    ("flexiv_rizon4", "Rizon 4", "Flexiv", "arm", 7, "Apache-2.0", False),
    ("flexiv_rizon4s", "Rizon 4S", "Flexiv", "arm", 7, "Apache-2.0", False),
    ("xarm7", "xArm7", "UFACTORY", "arm", 7, "BSD-3-Clause", False),
    ("lite6", "Lite 6", "UFACTORY", "arm", 6, "BSD-3-Clause", False),
    ("viperx300", "ViperX 300 6DOF", "Trossen", "arm", 6, "BSD-3-Clause", False),
    ("widowx250", "WidowX 250 6DOF", "Trossen", "arm", 6, "BSD-3-Clause", False),
    ("unitree_z1", "Z1", "Unitree", "arm", 6, "BSD-3-Clause", False),
    ("arx_l5", "L5", "ARX", "arm", 6, "BSD-3-Clause", False),
    ("agilex_piper", "PiPER", "AgileX", "arm", 6, "MIT", False),
    ("rethink_sawyer", "Sawyer", "Rethink Robotics", "arm", 7, "Apache-2.0", False),
    ("so_arm100", "SO-ARM100", "TheRobotStudio", "arm", 5, "Apache-2.0", False),
    ("low_cost_arm", "Low-Cost Robot Arm", "Community", "arm", 5, "Apache-2.0", False),
    ("yam", "YAM", "I2RT", "arm", 6, "MIT", False),
    ("seeed_devarm", "reBot DevArm", "Seeed Studio", "arm", 6, "MIT", False),
    ("aloha", "ALOHA", "Stanford / Trossen", "bimanual", 14, "BSD-3-Clause", False),
    ("shadow_hand", "Hand E3M5", "Shadow Robot", "hand", 24, "Apache-2.0", False),
    ("shadow_dex_ee", "DEX-EE", "Shadow Robot", "hand", 12, "Apache-2.0", False),
    ("allegro_hand", "Allegro Hand V3", "Wonik", "hand", 16, "BSD-2-Clause", False),
    ("leap_hand", "Leap Hand", "CMU", "hand", 16, "MIT", False),
    ("robotiq_2f85", "2F-85", "Robotiq", "gripper", 1, "BSD-2-Clause", False),
    ("panda_gripper", "Panda Gripper", "Franka Emika", "gripper", 1, "Apache-2.0", False),
    ("umi_gripper", "UMI Gripper", "Stanford", "gripper", 1, "MIT", False),
    ("sharpa_wave", "Sharpa Wave", "Sharpa", "hand", 16, "Apache-2.0", False),
    ("xarm7_gripper", "xArm Gripper", "UFACTORY", "gripper", 1, "BSD-3-Clause", False),
    ("stretch3", "Stretch 3", "Hello Robot", "mobile_manipulator", 7, "Apache-2.0", False),
    ("stretch2", "Stretch 2", "Hello Robot", "mobile_manipulator", 7, "BSD-3-Clause-Clear", False),
    ("pal_tiago", "TIAGo", "PAL Robotics", "mobile_manipulator", 8, "Apache-2.0", False),
    ("pal_tiago_dual", "TIAGo++", "PAL Robotics", "mobile_manipulator", 15, "Apache-2.0", False),
    ("google_robot", "Google Robot", "Google", "mobile_manipulator", 7, "Apache-2.0", False),
    ("tidybot", "TidyBot", "Stanford", "mobile_manipulator", 7, "MIT", False),
    ("skydio_x2", "X2", "Skydio", "drone", 4, "Apache-2.0", False),
    ("crazyflie2", "Crazyflie 2", "Bitcraze", "drone", 4, "MIT", False),
)

# --- Fixed values: joint limits (rad) and speed caps (rad/s) per machine type ---
JOINT_LIMITS = {
    "franka_panda": (
        [[-2.8973, 2.8973], [-1.7628, 1.7628], [-2.8973, 2.8973], [-3.0718, -0.0698],
         [-2.8973, 2.8973], [-0.0175, 3.7525], [-2.8973, 2.8973]],
        [2.175, 2.175, 2.175, 2.175, 2.61, 2.61, 2.61],
    ),
    "ur5e": ([[-6.2832, 6.2832]] * 6, [3.15, 3.15, 3.15, 3.2, 3.2, 3.2]),
    "viperx300": (
        [[-3.1416, 3.1416], [-1.8850, 1.9897], [-1.7907, 1.6231], [-3.1416, 3.1416],
         [-1.7453, 2.1468], [-3.1416, 3.1416]],
        [3.0] * 6,
    ),
    "widowx250": (
        [[-3.1416, 3.1416], [-1.8850, 1.9897], [-1.7907, 1.6231], [-3.1416, 3.1416],
         [-1.7453, 2.1468], [-3.1416, 3.1416]],
        [3.0] * 6,
    ),
    "so_arm100": (
        [[-2.0, 2.0], [-1.75, 1.75], [-1.6, 1.6], [-1.75, 1.75], [-2.7, 2.7]],
        [4.8] * 5,
    ),
}
