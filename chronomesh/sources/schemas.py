"""Table schemas and closed dictionaries."""

from __future__ import annotations

from pyspark.sql import types as T

CONN = T.StructType([
    T.StructField("conn_id", T.LongType()),
    T.StructField("file_id", T.IntegerType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("datetime", T.TimestampNTZType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("dest_port", T.IntegerType()),
    T.StructField("proto", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("conn_state", T.StringType()),
    T.StructField("orig_bytes", T.LongType()),
    T.StructField("orig_pkts", T.LongType()),
    T.StructField("resp_bytes", T.LongType()),
    T.StructField("resp_pkts", T.LongType()),
    T.StructField("missed_bytes", T.LongType()),
    T.StructField("local_orig", T.BooleanType()),
    T.StructField("local_resp", T.BooleanType()),
    T.StructField("history", T.StringType()),
    T.StructField("label_tactic", T.StringType()),
])

AUTH = T.StructType([
    T.StructField("time", T.LongType()),
    T.StructField("src_user", T.StringType()),
    T.StructField("dst_user", T.StringType()),
    T.StructField("src_computer", T.StringType()),
    T.StructField("dst_computer", T.StringType()),
    T.StructField("auth_type", T.StringType()),
    T.StructField("logon_type", T.StringType()),
    T.StructField("orientation", T.StringType()),
    T.StructField("result", T.StringType()),
])

REDTEAM = T.StructType([
    T.StructField("time", T.LongType()),
    T.StructField("user_name", T.StringType()),
    T.StructField("src_computer", T.StringType()),
    T.StructField("dst_computer", T.StringType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

# The position of a value is its physical code, so order matters.
SERVICE = [
    "dce_rpc,ntlm,smb,gssapi", "dce_rpc", "dce_rpc,smb,gssapi,ntlm", "gssapi", "smb,gssapi,ntlm",
    "gssapi,dce_rpc,smb,ntlm", "ssl", "ntlm,gssapi,dce_rpc,smb", "dhcp", "smb", "dns", "None",
    "smb,dce_rpc,ntlm,gssapi", "ntlm,smb,gssapi", "ntp", "ssh", "gssapi,smb,ntlm", "gssapi,smb",
    "smb,gssapi", "radius", "ntlm,dce_rpc,gssapi,smb", "krb_tcp", "gssapi,dce_rpc,ntlm,smb",
    "gssapi,smb,ntlm,dce_rpc", "gssapi,smb,dce_rpc,ntlm", "ftp", "snmp", "smb,ntlm,gssapi",
    "ntlm,dce_rpc,smb,gssapi", "ntlm,gssapi,smb", "gssapi,ntlm,smb", "http",
]
PROTO = ["icmp", "udp", "tcp"]
CONN_STATE = ["RSTO", "S1", "RSTRH", "RSTR", "SHR", "S3", "OTH", "SH", "S2", "REJ", "S0", "SF"]
CONN_STATUS = ["starting", "open", "closing"]
LABEL_TACTIC = [
    "none", "Privilege Escalation", "Collection", "Initial Access", "Credential Access",
    "Resource Development", "Lateral Movement", "Command and Control", "Execution",
    "Defense Evasion", "Persistence", "Discovery", "Exfiltration", "Reconnaissance",
]
AUTH_TYPE = [
    "MICROSOFT_AUTHENTICATION_PACKAG", "ACRONIS_RELOGON_AUTHENTICATION_PACKAGE",
    "MICROSOFT_AUTHENTICATIO", "MICROSOFT_AUTHENTICATION_PACKAGE_", "MICROSOFT_AUTHENTICATION_PACKA",
    "MICROSOFT_AUTHENTICATION_PAC", "MICROSOFT_AUTHENTICA", "MICROSOFT_AUTHENTICATION_PACKAGE_V1_0",
    "MICROSOFT_AUTHENTICATION_PACKAGE_V1", "Negotiate", "MICROSOFT_AUTHENTICATION_PACK", "Wave",
    "MICROSOFT_AUTHENTICATI", "MICROSOFT_AUTHENTICATION", "MICROSOFT_AUTHENTICATION_PACKAGE",
    "MICROSOFT_AUTHENTICATION_P", "?", "MICROSOFT_AUTHENTICATION_PACKAGE_V1_",
    "MICROSOFT_AUTHENTICATION_PACKAGE_V", "NETWARE_AUTHENTICATION_PACKAGE_V1_0", "N", "CygwinLsa",
    "MICROSOFT_AUTHENTICAT", "MICROSOFT_AUTHENTICATION_", "Kerberos", "NTLM",
    "MICROSOFT_AUTHENTICATION_PA", "Setuid", "TivoliAP",
]
LOGON_TYPE = [
    "Batch", "Network", "Service", "NewCredentials", "RemoteInteractive", "?", "CachedInteractive",
    "NetworkCleartext", "Unlock", "Interactive",
]
ORIENTATION = ["TGT", "ScreenUnlock", "TGS", "AuthMap", "ScreenLock", "LogOff", "LogOn"]
RESULT = ["Fail", "Success"]
# End of fixed values.

#: Split stages by code.
STAGES = ["Training", "Validation", "Testing"]
