"""Explicit schemas of every table, as DDL text."""

FRAMES = ("frame_id BIGINT, run_id STRING, tablet_id INT, light STRING, stage STRING, z DOUBLE, idx INT, "
          "captured_at TIMESTAMP, height INT, width INT, n_channels INT, data BINARY")
LINES = ("frame_id BIGINT, height INT, y INT, vals ARRAY<DOUBLE>")
PIXELS = ("frame_id BIGINT, y INT, x INT, v DOUBLE")
GRAY_HIST = ("frame_id BIGINT, v INT, n BIGINT")
BOXES = ("frame_id BIGINT, box STRUCT<x1:INT,y1:INT,x2:INT,y2:INT>")
CONTOUR_POINTS = ("frame_id BIGINT, i INT, x INT, y INT, scale DOUBLE")
MASK_SPANS = ("frame_id BIGINT, y INT, x_start INT, x_end INT")
SCAN_POINTS = ("scan_id BIGINT, i INT, z DOUBLE, sobel DOUBLE, lap DOUBLE")
REQUEST_SCHEMA = ("tablet_index INT, x DOUBLE, y DOUBLE, z DOUBLE, measurement_folder STRING, "
                    "measurement_name STRING, autofocus BOOLEAN, lamp_top BOOLEAN, lamp_side BOOLEAN, "
                    "is_first_tablet BOOLEAN, background_subtraction BOOLEAN")
RESPONSE_SCHEMA = ("status STRING, message STRING, tablet_index INT, saved_images ARRAY<STRING>, "
                     "af_error_code STRING, af_error_message STRING")
OUTCOMES = ("run_id STRING, tablet_id INT, state STRING, error_code STRING, message STRING, images ARRAY<STRING>")
RESULTS = ("ts TIMESTAMP, id STRING, operator STRING, clogged INT, partially_clogged INT, clean INT, result STRING")
SETTINGS = ("category STRING, name STRING, value STRING, type STRING")
LIMITS = ("name STRING, min DOUBLE, max DOUBLE, inc DOUBLE")
AXIS_LIMITS = ("axis STRING, lo DOUBLE, hi DOUBLE")
ERROR_MESSAGES = ("code STRING, message STRING")
ERRORS = ("ts TIMESTAMP, code STRING, message STRING, popup_style STRING, abort BOOLEAN")
PRESETS = ("camera_profile_path STRING, exposure_time_dome DOUBLE, exposure_time_bar DOUBLE, "
             "gamma_dome DOUBLE, gamma_bar DOUBLE")
PROFILES = ("file STRING, line_no INT, feature STRING, value STRING, selectors MAP<STRING,STRING>")
CAPTURES = ("path STRING, name STRING, ts TIMESTAMP, label STRING, light STRING, masked BOOLEAN")
POSITIONS = ("device STRING, ts TIMESTAMP, x DOUBLE, y DOUBLE, z DOUBLE")
LAMP_EVENTS = ("lamp STRING, ts TIMESTAMP, action STRING")
DEVICE_STATUS = ("device STRING, ts TIMESTAMP, connected BOOLEAN, streaming BOOLEAN")
LOGS = ("ts TIMESTAMP, level STRING, logger STRING, message STRING")
