"""Table layouts, as DDL strings."""

FRAMES = "detector string, path string, frame_idx int, h int, w int, pixels array<float>"
PANELS = (
    "detector string, panel string, panel_order long, n_ss int, n_fs int, fs_vec array<double>, ss_vec array<double>, "
    "t_vec array<double>, ss0 int, ss1 int, fs0 int, fs1 int, module int"
)
SESSIONS = "detector string, session_id string, frame_count long"
SPLIT = "fold int, variant string, test_detector string, session_id string, bucket string"
SPLIT_ARTIFACT = "fold int, variant string, test_detector string, splits map<string,string>"
METRICS = "ap double, auc_roc double, f1 double, threshold double"
FOLD_RESULT = (
    "fold_id int, test_detector string, "
    f"cross struct<{METRICS.replace(' double', ':double')}>, in_domain struct<{METRICS.replace(' double', ':double')}>"
)
EPOCH_LOG = (
    "run string, epoch int, train_loss double, val_loss double, val_ap double, val_auc double, val_f1 double"
)
