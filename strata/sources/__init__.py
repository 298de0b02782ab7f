"""Python data sources: file trees and archives."""
