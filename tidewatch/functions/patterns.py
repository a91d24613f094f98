"""The ordered patterns by which lines are classified. Order matters, the first match wins."""

CATEGORIES = {
    "tls_handshake_error": ("TlsConnectionException", "error completing the handshake", "SSL handshake", "TLS handshake"),
    "connection_timeout": ("did not properly respond after a period of time", "connection attempt failed", "timed out", "timeout"),
    "connection_refused": ("connection was forcibly closed", "actively refused", "Connection refused", "target machine actively refused"),
    "host_unreachable": ("host has failed to respond", "No route to host", "network is unreachable", "host is down"),
    "socket_exception": ("SocketException", "socket error", "WSAECONNRESET"),
    "proxy_disconnect": ("logged off", "federated proxy", "Initial sync context is null", "proxy connection lost"),
    "sql_connection": ("SqlException", "SQL Server", "database connection"),
    "certificate_error": ("certificate", "cert validation", "trust relationship"),
    "scheduling_reconnect": ("Scheduling reconnection", "reconnect attempt", "startDelay"),
    "internal_error_logon": ("result Failure () while at step Waiting for message", "LogonFailedEventArgs.FailureCode=Failure", "OnFederatedProxy_LogonFailed"),
    "internal_error_prefetch": ("prefetch failed", "Prefetch query failed", "The prefetch failed (Base)", "The prefetch failed (DirectoryRole)", "The prefetch failed (DirectoryServers)"),
    "internal_error_directory": ("not currently connected to the Directory", "Directory and cannot handle your request"),
    "internal_error_sync": ("Entity synchronization failed", "Aborting synchronization", "Failed to map local and remote custom fields"),
    "internal_error_tls_auth": ("TLS authentication failed", "TLS authentication failed when connecting"),
}
SUBTYPES = {
    "empty_redirection": r"result Failure \(\) while at step Waiting for message: RedirectionResponseMessage",
    "empty_logon": r"result Failure \(\) while at step Waiting for message: LogOnResultMessage",
    "prefetch_base": r"(?i)prefetch failed \(Base\)",
    "prefetch_directory_role": r"(?i)prefetch failed \(DirectoryRole\)",
    "prefetch_directory_servers": r"(?i)prefetch failed \(DirectoryServers\)",
    "directory_disconnected": r"not currently connected to the Directory",
    "tls_auth_failed": r"TLS authentication failed",
    "handshake_error": r"error completing the handshake",
    "read_timeout": r"Read timeout occured",
    "transport_read_error": r"Unable to read data from the transport connection",
    "sync_aborted": r"Aborting synchronization",
    "entity_sync_failed": r"Entity synchronization failed",
    "custom_fields_failed": r"Failed to map local and remote custom fields",
    "logon_failed_event": r"OnFederatedProxy_LogonFailed.*FailureCode=Failure",
    "security_token_error": r"Raising WFSecurityTokensManager",
}
SEVERITIES = {"fatal": "(fatal)", "error": "(error)", "warning": "(warning)", "exception": "exception"}
REASONS = {
    "connection_timeout": r"connection attempt failed.*did not properly respond after a period of time",
    "host_failed_respond": r"connected host has failed to respond",
    "tls_connection_error": r"TlsConnectionException",
    "socket_exception": r"SocketException",
    "connection_refused": r"connection.*refused|actively refused",
    "network_unreachable": r"network.*unreachable|no route to host",
    "ssl_handshake_failed": r"ssl.*handshake|tls.*handshake|handshake.*fail",
    "certificate_error": r"certificate|cert.*error|cert.*invalid",
    "dns_resolution": r"dns|name.*resolution|could not resolve",
    "proxy_logged_off": r"federated proxy.*logged off|Initial sync context is null",
    "authentication_failed": r"authentication.*fail|login.*fail|credential",
    "service_unavailable": r"service.*unavailable|503",
    "internal_error": r"internal.*error|500",
    "scheduling_reconnect": r"Scheduling reconnection with startDelay",
}
REASON_KEYWORDS = (
    "connection", "respond", "tls", "socket", "refused", "network", "ssl", "handshake", "certificate", "cert", "dns", "resolution", "resolve",
    "proxy", "logged off", "sync context", "authentication", "login", "credential", "service", "503", "500", "internal", "scheduling", "reconnection",
)
# What is read off a line.
STORE = r"Store[\s_](\d{4,5})"
IP_PORT = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}):(\d+)"
ENDPOINT = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}:\d+)"
ROLE_GROUP = r"(SBUXSCRoleGroup\d+)"
MACHINE = r"MachineName=(\S+)"
START_DELAY = r"startDelay\s*=\s*(\d+)"
# Labels of lines, case counts.
FLAGS = {
    "error": ("(Error)", "(error)"), "warning": ("(Warning)", "(warning)"), "exception": ("Exception", "exception"), "fatal": ("(Fatal)", "(fatal)", "Fatal", "fatal"),
    "connection": ("connection", "disconnect", "reconnect", "logged off", "logon", "logoff"),
}
# Phrases of lost and regained connections, in lower case; the broad rules' and the narrow ones'.
NULL_SYNC = "Initial sync context is null"
LOST_BROAD, BACK_BROAD = ("logged off", "disconnect", "offline"), ("reconnect", "logon", "online", "connected", "sync complete", "primary sync")
LOST, BACK = (
    "logged off",
    "disconnect",
    "offline",
    "connection failed",
    "connection attempt failed",
), ("logon", "sync complete", "connected successfully", "scheduling reconnection")
