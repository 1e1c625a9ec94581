"""Fixed schemas of the data model. Nothing is inferred; "now" is always an argument."""

BACKUP_SET = (
    "backup_set_id bigint, media_set_id bigint, server_name string, database_name string, "
    "backup_start_date timestamp_ntz, backup_finish_date timestamp_ntz, type string, recovery_model string"
)
MEDIA_FAMILY = "media_set_id bigint, physical_device_name string"
POLICY = (
    "server_name string, database_name string, backup_type string, backup_rule string, backup_location string, "
    "backup_interval_minutes int, backup_window_start timestamp_ntz, backup_window_end_hours int, blocksize int, "
    "buffercount int, maxtransfersize int, do_dbcc int, cleanup_time int, forced_day int, max_failure_count int, "
    "status string"
)
METADATA = "server_name string, key_code string, key_description string, key_value string"
QUEUE = (
    "id bigint, database_name string, backup_type string, backup_rule string, backup_location string, "
    "current_window_start timestamp_ntz, current_window_end timestamp_ntz, backup_delta int, "
    "queue_time timestamp_ntz, unqueue_time timestamp_ntz, is_selected int, status string, blocksize int, "
    "buffercount int, maxtransfersize int, do_dbcc int, max_failure_count int"
)
ATTEMPTS = "job_id bigint, attempt int, ok boolean, message string, at timestamp_ntz"
COMMAND_LOG = (
    "id bigint, database_name string, command string, command_type string, start_time timestamp_ntz, "
    "end_time timestamp_ntz, error_number int, error_message string"
)
FINDINGS = (
    "error int, level int, state int, message_text string, repair_level string, status int, db_id int, "
    "db_frag_id int, object_id bigint, index_id bigint, partition_id bigint, alloc_unit_id bigint, rid_db_id int, "
    "rid_pru_id int, file int, page int, slot int, ref_db_id int, ref_pru_id int, ref_file int, ref_page int, "
    "ref_slot int, allocation int"
)
RESTORE_LOG = (
    "id int, restore_database_name string, restore_server_name string, server_name string, "
    "end_time timestamp_ntz, dbcc_status int, delete_after_check int, delete_status int"
)
DELETE_LOG = (
    "server_name string, database_name string, dbtype string, backup_finish_date timestamp_ntz, root string, "
    "ns_physical_device_name string, last_write_time timestamp_ntz, row_num int, full_sets int, time_stamp string, "
    "delete_status int, error_message string"
)
DISK_HISTORY = (
    "computer_name string, name string, label string, percent_free double, block_size bigint, drive_type string, "
    "size_bytes bigint, free_bytes bigint, size_mb bigint, free_mb bigint, size_gb bigint, free_gb bigint, "
    "time timestamp_ntz"
)
AUDIT_LOG = (
    "server_name string, event_time timestamp_ntz, sequence_number int, action_id string, class_type string, "
    "succeeded boolean, session_id int, session_server_principal_name string, server_principal_name string, "
    "client_ip string, application_name string, database_principal_name string, database_name string, "
    "schema_name string, object_name string, statement string, response_rows bigint, affected_rows bigint"
)
CATALOG = (
    "server_name string, db_name string, object_type string, object_name string, column_name string, "
    "type_name string"
)
SHIFTS = "win_login string, mentor_login string, full_name string"
DEPLOY_CONFIG = (
    "Environment string, TargetServer string, "
    "Servers array<struct<ServerName: string, Databases: array<struct<Name: string, NewName: string, "
    "Action: string>>>>"
)
COLLABORATORS = "repo string, login string, role string"
MERGED = "title string, headRefName string, mergedAt timestamp, mergeStateStatus string, state string"

# Log codes, status codes and limits, as the data model states them.
OUTCOME_CODES = [
    ("ok", 0), ("max_failure", 222), ("no_backup_rule", 223), ("sync", 224), ("snapshot", 225), ("out_of_window", 231),
]
ALLOCATION_ERROR = 8989
CHECK_OK = 7
ACTION_FAILED = 2
FILE_DELETED = 7
DATABASE_DELETED = 1
HISTORY_DAYS = 45
ARCHIVE_YEARS = 2
MAX_COPY_MB = 35_000
DEPLOY_ACTIONS = ["DetachAttach", "BackupRestore"]
CAPPED_ACTIONS = ["BackupRestore"]
DRY_RUN_LINE = "-Action %s -SourceServer %s -TargetServer %s -Database %s -NewDBName %s"
LOG_TIME = "yyyy-MM-dd HH:mm:ss"
FILE_DATE = "ddMMyyyy"
PII_NAME_PATTERNS = [
    "%mail%", "%first%name%", "%last%name%", "%birth%", "%sex%", "%address%", "%phone%", "%ssn%", "%postcode%",
    "%gender%",
]
SYSTEM_DATABASES = ["msdb", "tempdb", "master"]
VOWELS = "aeiouy"
